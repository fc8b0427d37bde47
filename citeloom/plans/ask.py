"""Ask a batch of questions: rank, gate, answer, ladder; one plan for the whole batch."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.operators import answers as an
from citeloom.operators import filters as fl
from citeloom.operators import gate, ranking, scan
from citeloom.plans.index import CorpusIndex
from citeloom.session import broadcast_if, materialise, pinned


@dataclass
class Ranking:
    """What a batch is ranked by, before any cut: ``weights`` of its terms, ``damped`` by their counts, and the lists of the
    blocks that are allowed. ``scored`` is every question-block pair; ``best`` reads only what can stand among the first."""

    index: CorpusIndex
    batch: ranking.QuestionBatch
    neighbors: DataFrame
    weights: DataFrame
    damped: DataFrame
    allowed: DataFrame | None = None
    _hits: DataFrame | None = None
    _best: tuple[int, DataFrame] | None = None

    @cached_property
    def terms(self) -> DataFrame:
        """Terms of the allowed blocks."""
        return self.index.terms if self.allowed is None else fl.keep_allowed(self.index.terms, self.allowed)

    @cached_property
    def scored(self) -> DataFrame:
        return ranking.score_blocks(ranking.cut_by_pairs(self.terms, self.damped), self.damped, self.batch.small)

    @cached_property
    def postings(self) -> DataFrame:
        """Lists of the batch's terms over the allowed blocks."""
        return allowed_postings(self.index, self.damped, self.batch, self.allowed)

    def best(self, depth: int) -> DataFrame:
        """First ``depth`` blocks of each question; a deeper answer serves shallower ones."""
        if self._best is None or self._best[0] < depth:
            small, local = self.batch.small, self.batch.local
            if not self.index.holds("posting_lists"):
                self._best = depth, pinned(ranking.best_blocks(self.terms, self.damped, depth, small), "top", local)
                return self._best[1]
            if self._hits is None:  # the same for every depth
                self._hits = materialise(ranking.direct_hits(self.postings, self.damped, small), "hits")
            floors = pinned(ranking.hit_floors(self._hits, depth), "floors", local)
            scored = ranking.score_contenders(self._hits, floors, self.postings, self.damped, small)
            self._best = depth, pinned(ranking.top_blocks(scored, depth), "top", local)
        return self._best[1].filter(F.col("candidate_rank") <= depth)


def allowed_postings(index: CorpusIndex, weights: DataFrame, batch: ranking.QuestionBatch, allowed: DataFrame | None) -> DataFrame:
    if index.holds("posting_lists"):
        rows = index.posting_lists.pick(ranking.named(weights, batch))
    else:
        rows = scan.posting_rows(index.terms, weights, batch.small)
    return rows if allowed is None else fl.keep_allowed(rows, allowed)


@dataclass
class Packets:
    """Everything a batch of questions yields, each table keyed by ``question_id``; answers and
    ladder are built when first asked for."""

    ranking: Ranking
    candidates: DataFrame
    qualified: DataFrame
    locations: DataFrame
    rejected: DataFrame

    @property
    def questions(self) -> DataFrame:
        return self.ranking.batch.questions

    @cached_property
    def answers(self) -> DataFrame:
        return materialise(an.cited_answers(self.locations, self.questions), "answers")

    @cached_property
    def ladder(self) -> DataFrame:
        return an.support_ladder(self.locations, self.answers, self.questions)


def batch_neighbors(index: CorpusIndex, batch: ranking.QuestionBatch) -> DataFrame:
    """Neighbour terms of a batch, from the lists where the index has them, else from one pass over its terms."""
    if index.holds("neighbor_lists"):
        return ranking.relation_neighbors(index.neighbor_lists, index.list_heads, batch, stop=index.stop, window=index.window)
    known = index.count_list.pick(batch.anchors)
    return scan.batch_neighbors(index.terms, index.counts, batch, known, stop=index.stop, window=index.window)


def rank_blocks(index: CorpusIndex, questions: DataFrame | ranking.QuestionBatch, *, created_after=None, created_before=None,
                speaker: str | None = None, near: DataFrame | None = None) -> Ranking:
    """``near`` holds the batch's neighbours where another ranking of it has them: they are those of all blocks, whatever the filter."""
    batch = questions if isinstance(questions, ranking.QuestionBatch) else ranking.question_batch(questions, index.stop)
    # short tables that several branches read: pinned once, so no branch repeats their work
    near = pinned(batch_neighbors(index, batch), "neighbors", batch.local) if near is None else near
    weights = pinned(ranking.question_weights(batch.seeds, near), "weights", batch.local)
    allowed = None
    if created_after or created_before or speaker:
        # the filter goes before scoring: posting counts are those of the blocks that stay
        allowed = fl.allowed_blocks(index.filters, index.blocks, created_after=created_after, created_before=created_before, speaker=speaker)
        counts = allowed_postings(index, weights, batch, allowed).join(
            broadcast_if(weights.select("anchor").distinct(), batch.small), "anchor", "left_semi").groupBy("anchor").agg(F.sum("tf").alias("observations"))
    else:
        counts = index.count_list.pick(ranking.named(weights, batch))
    damped = pinned(ranking.damped(weights, counts, batch.small), "damped", batch.local)
    return Ranking(index, batch, near, weights, damped, allowed)


def candidate_depth(top_k: int) -> int:
    return max(top_k * fv.CANDIDATES_PER_ANSWER, fv.MIN_CANDIDATES)


def candidates(ranked: Ranking, depth: int) -> DataFrame:
    return ranking.fetch_candidates(ranked.best(depth), ranked.index.blocks, ranked.index.terms, ranked.weights, ranked.batch.small)


def ask(index: CorpusIndex, questions: DataFrame | ranking.QuestionBatch, *, top_k: int = 5, created_after=None, created_before=None,
        speaker: str | None = None) -> Packets:
    return packets_of(rank_blocks(index, questions, created_after=created_after, created_before=created_before, speaker=speaker), top_k)


def packets_of(ranked: Ranking, top_k: int = 5) -> Packets:
    """Packets of a ranked batch; one ranking serves any ``top_k``."""
    found = candidates(ranked, candidate_depth(top_k))
    qualified = materialise(gate.qualify(found, ranked.batch.questions, top_k=top_k, small=ranked.batch.small, stop=ranked.index.stop), "qualified")
    locations = qualified.filter(F.col("location_rank").isNotNull())
    rejected = qualified.filter(F.col("rejected_rank").isNotNull())
    return Packets(ranked, found, qualified, locations, rejected)


def one_question(index: CorpusIndex, question: str, **options) -> Packets:
    row = index.spark.createDataFrame([("q1", question)], "question_id string, question string")
    packets = ask(index, row, **options)
    if packets.questions.filter(F.size("seed_terms") == 0).head() is not None:
        raise ValueError("question produced no anchors")
    return packets


def batch_summary(packets: Packets, elapsed_seconds: float | None = None) -> DataFrame:
    """Completed and failed questions of a batch; a question without anchors fails."""
    return packets.questions.agg(
        F.count("*").alias("question_count"),
        F.count_if(F.size("seed_terms") > 0).alias("completed"),
        F.count_if(F.size("seed_terms") == 0).alias("failed"),
        F.lit(elapsed_seconds).cast("double").alias("total_seconds"),
        (F.lit(elapsed_seconds).cast("double") / F.greatest(F.lit(1), F.count("*"))).alias("average_seconds"))


def packet_rows(packets: Packets, run_id: str) -> DataFrame:
    """One nested row per question, ready to append to a packets table."""
    location = F.struct("location_rank", "citation", "source_path", "line_start", "line_end", "score", "density_score",
                        "block_anchor_count", "direct_hit_count", "direct_matched_anchors", "matched_anchors",
                        "coverage", "covered_terms", "missing_terms", "qualified_score", "text")
    found = packets.locations.groupBy("question_id").agg(F.sort_array(F.collect_list(location)).alias("locations"))
    near = packets.ranking.neighbors.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("neighbor_rank", "neighbor", "score"))).alias("relation_neighbors"))
    summary = gate.summary(packets.qualified, packets.questions).drop("question")
    ladder = packets.ladder.withColumnRenamed("citations", "ladder_citations")
    return (packets.questions.select(F.lit(run_id).alias("run_id"), "question_id", F.col("seed_terms").alias("question_anchors"))
            .join(packets.answers, "question_id").join(summary, "question_id").join(ladder, "question_id")
            .join(near, "question_id", "left").join(found, "question_id", "left"))


def write_packets(packets: Packets, path: str, run_id: str) -> None:
    packet_rows(packets, run_id).write.mode("append").partitionBy("run_id").parquet(path)
