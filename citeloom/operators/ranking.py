"""Ranking: question seeds, neighbour terms, weights, block scores, candidate top-k.

All questions of a batch are one plan keyed by ``question_id``. ``small`` says that the
question side was counted and is short enough to broadcast; without it the joins are left
to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.operators.blocks import number_in_groups
from citeloom.operators.lists import KeyedFiles
from citeloom.session import at_most, broadcast_if, materialise, pinned

# Scores are summed as fixed-point integers: the sum is exact and does not depend on the
# order in which tasks deliver rows, so equal blocks get equal ranks on every run.
FIXED_POINT = 1e12
BROADCAST_SEEDS = 200_000
#: A batch with at most so many seeds keeps its short tables in the plan and names its terms there.
LOCAL_SEEDS = 20_000
#: Candidates are taken from list fronts first if the fronts are less than this share of the lists.
FRONT_SHARE = 0.25


@dataclass
class QuestionBatch:
    """``questions`` with base anchors (distinct, in order) and expanded seeds. ``anchors`` names the distinct seeds of a
    batch of at most ``LOCAL_SEEDS`` seeds."""

    questions: DataFrame
    seeds: DataFrame
    small: bool
    anchors: list[str] | None = None

    @property
    def local(self) -> bool:
        return self.anchors is not None

    @cached_property
    def base_anchors(self) -> list[str] | None:
        """Distinct question terms of a local batch."""
        return sorted({a for r in self.questions.select("base_terms").collect() for a in r[0]}) if self.local else None


def question_batch(questions: DataFrame, stop=fv.STOP_TERMS, max_seeds: int = BROADCAST_SEEDS, local_seeds: int = LOCAL_SEEDS) -> QuestionBatch:
    stop = tuple(stop)
    words = tx.anchors(F.col("question"), stop)
    prepared = questions.withColumn("_words", words).select(
        *questions.columns, F.array_distinct("_words").alias("base_terms"),
        tx.expand(F.col("_words"), stop).alias("seed_terms"))
    rows = prepared.limit(local_seeds + 1).toArrow()
    terms = rows.column("seed_terms").combine_chunks().flatten() if rows.num_rows else None
    if rows.num_rows <= local_seeds and (terms is None or len(terms) <= local_seeds):
        prepared = questions.sparkSession.createDataFrame(rows, schema=prepared.schema)
        return QuestionBatch(prepared, seed_rows(prepared, "seed_terms"), True, sorted(set(terms.to_pylist())) if terms is not None else [])
    prepared = materialise(prepared, "questions")
    seeds = seed_rows(prepared, "seed_terms")
    return QuestionBatch(prepared, seeds, at_most(seeds, max_seeds))


def named(weights: DataFrame, batch: QuestionBatch) -> list[str] | None:
    """Distinct anchors of a local batch's weights; its rows lie in the plan, so no job runs."""
    return sorted({r[0] for r in weights.select("anchor").collect()}) if batch.local else None


def seed_rows(prepared: DataFrame, column: str) -> DataFrame:
    return prepared.select("question_id", F.posexplode(column).alias("seed_at", "anchor"))


def relation_neighbors(lists: KeyedFiles, heads: KeyedFiles, batch: QuestionBatch, *, stop=fv.STOP_TERMS, limit: int = fv.NEIGHBOR_LIMIT,
                       window: int = fv.RELATION_WINDOW) -> DataFrame:
    """Strongest neighbour terms of each question: observation totals over its seeds, without
    the seeds themselves and stop terms; ties go to the first seed, then the neighbour, by
    code point.

    The lists are in order of impact, and ``heads`` tells how many entries each level of a list
    has, so a list is read from its front only as far as it matters. If a question has S seeds
    with a list and one list has at least limit + S entries of v observations or more, then v
    bounds the last neighbour from below, for at most S of those entries are seeds. What can
    reach v in total has an entry of v / S or more in one list: those fronts name the
    candidates, and only candidates are looked up in the rest of the lists. (Where the fronts
    are most of the lists, as the heads tell, the lists are read once and whole.) A neighbour
    seen n times can total at most 2·window·n. The cuts are exact.
    """
    small = batch.small
    ask = batch.seeds.select("question_id", "anchor")
    used = ask.select("anchor").distinct()
    histogram = heads.pick(batch.anchors).join(broadcast_if(used, small), "anchor", "left_semi")
    down = W.partitionBy("anchor").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    reach = histogram.withColumn("reach", F.sum("entries").over(down))
    held = ask.join(broadcast_if(histogram.select("anchor").distinct(), small), "anchor", "left_semi")
    sized = held.join(held.groupBy("question_id").agg(F.count("*").alias("seeds")), "question_id")
    floors = (reach.join(broadcast_if(sized, small), "anchor").filter(F.col("reach") >= F.col("seeds") + limit)
              .groupBy("question_id").agg(F.max(F.pow(F.lit(2.0), "level")).alias("floor")))
    # a seed's place by code point stands for the seed in tie breaks: a number keeps the
    # aggregation below hash-based, a string minimum would make it sort
    place = F.row_number().over(W.partitionBy("question_id").orderBy("anchor"))
    ask = (ask.withColumn("seed_place", place).join(broadcast_if(sized, small), ["question_id", "anchor"])
           .join(broadcast_if(floors, small), "question_id", "left").na.fill(0, ["floor"]).withColumn("front", F.col("floor") / F.col("seeds")))
    ask = pinned(ask, "floors", batch.local)
    lowest = ask.groupBy("anchor").agg(F.min("floor").alias("lowest"), F.min("front").alias("least"))
    can_reach = F.col("neighbor_observations") * (2 * window)
    near = lists.pick(batch.anchors).filter(~F.col("neighbor").isin(list(stop)))
    near = near.join(broadcast_if(lowest, small), "anchor").filter(can_reach >= F.col("lowest"))
    own = batch.seeds.select("question_id", F.col("anchor").alias("neighbor"))
    met = near.drop("lowest").join(broadcast_if(ask, small), "anchor").filter(can_reach >= F.col("floor"))
    size = histogram.join(broadcast_if(ask.select("anchor", "front"), small), "anchor").agg(
        F.sum("entries").alias("all"), F.sum(F.when(F.pow(F.lit(2.0), F.col("level") + 1) > F.col("front"), F.col("entries"))).alias("fronts")).first()
    if (size["fronts"] or 0) < FRONT_SHARE * (size["all"] or 0):
        strong = near.filter(F.col("observations") >= F.col("least"))
        if batch.local:  # a number reaches the scan
            strong = strong.filter(F.col("observations") >= int(min((r[0] for r in ask.select("front").collect()), default=0)))
        found = (strong.drop("lowest").join(broadcast_if(ask, small), "anchor").filter((F.col("observations") >= F.col("front")) & (can_reach >= F.col("floor")))
                 .select("question_id", "neighbor").distinct().join(broadcast_if(own, small), ["question_id", "neighbor"], "left_anti"))
        met = met.join(found, ["question_id", "neighbor"], "left_semi")
    scored = met.groupBy("question_id", "neighbor").agg(F.sum("observations").alias("score"), F.min("seed_place").alias("first_seed"))
    scored = scored.join(broadcast_if(own, small), ["question_id", "neighbor"], "left_anti")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "first_seed", "neighbor")
    return (scored.withColumn("neighbor_rank", F.row_number().over(order))
            .filter(F.col("neighbor_rank") <= limit)
            .select("question_id", "neighbor", "score", "neighbor_rank"))


def tier_weight(rank: Column) -> Column:
    """4,4,4,4,3,3,3,3,… and never below 1, by 1-based rank."""
    return F.greatest(F.lit(1), fv.TOP_TIER_WEIGHT - F.floor((rank - 1) / fv.TIER_WIDTH).cast("int"))


def question_weights(seeds: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(question_id, anchor, weight, direct): 80 for a seed, the tier weight for a neighbour,
    both where a term is both."""
    direct = seeds.select("question_id", "anchor", F.lit(fv.DIRECT_WEIGHT).alias("weight"), F.lit(1).alias("direct"))
    near = neighbors.select("question_id", F.col("neighbor").alias("anchor"),
                            tier_weight(F.col("neighbor_rank")).alias("weight"), F.lit(0).alias("direct"))
    return direct.unionByName(near).groupBy("question_id", "anchor").agg(
        F.sum("weight").alias("weight"), F.max("direct").alias("direct"))


def damped(weights: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """Weights divided by the square root of the term's posting count, as fixed point."""
    joined = counts.join(broadcast_if(weights, small), "anchor")
    value = F.col("weight") * F.lit(FIXED_POINT) / F.greatest(F.lit(1.0), F.sqrt("observations"))
    return joined.select("question_id", "anchor", "direct", F.floor(value + 0.5).cast("bigint").alias("fixed_weight"))


def score_blocks(terms: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """Score of every (question, block) that holds a weighted term; each term counts once per
    block. ``terms`` is bucketed by block, so with a broadcast weight side this grouping runs
    where the blocks lie, with no exchange."""
    hits = terms.select("block_ordinal", "ordinal_range", "n_terms", F.explode(F.array_distinct("terms")).alias("anchor")).join(
        broadcast_if(weights, small), "anchor")
    return summed_scores(hits)


#: (question, block) pairs that one task groups, and terms whose pairs one task counts.
PAIRS_A_TASK = 1 << 20
TERMS_A_TASK = 1 << 19


def cut(terms: DataFrame, pieces: int) -> DataFrame:
    """Terms dealt by block to at least ``pieces`` tasks: buckets follow bytes, what a task groups follows blocks and questions."""
    return terms.repartition(pieces, "block_ordinal") if pieces > max(1, len(terms.inputFiles())) else terms


def cut_by_pairs(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """Terms in pieces of about ``PAIRS_A_TASK`` pairs with the questions of the weights."""
    return cut(terms, -(-terms.count() * weights.select("question_id").distinct().count() // PAIRS_A_TASK))


def cut_by_terms(terms: DataFrame) -> DataFrame:
    """Terms in pieces of about ``TERMS_A_TASK``."""
    return cut(terms, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS_A_TASK))


def best_blocks(terms: DataFrame, weights: DataFrame, depth: int, small: bool) -> DataFrame:
    """``top_blocks`` of all scored pairs, straight from the terms: direct hits come first in the order, so they are counted
    first, and only blocks with fewer than ``depth`` blocks ahead of them by hits alone are scored. Questions with fewer blocks
    that hold a seed take every block that holds one of their terms."""
    hits = score_blocks(cut_by_pairs(terms, weights), weights.filter("direct = 1"), small)
    ahead = F.rank().over(W.partitionBy("question_id").orderBy(F.desc("direct_hit_count")))
    held = materialise(hits.withColumn("_ahead", ahead).filter(F.col("_ahead") <= depth).select("question_id", "block_ordinal"), "contenders")
    full = materialise(held.groupBy("question_id").agg(F.count("*").alias("n")).filter(F.col("n") >= depth).select("question_id"), "full")
    near = held.join(broadcast_if(full, small), "question_id", "left_semi")
    rows = terms.join(broadcast_if(near, at_most(near, BROADCAST_NAMED)), "block_ordinal").select(
        "block_ordinal", "ordinal_range", "n_terms", "question_id", F.explode(F.array_distinct("terms")).alias("anchor"))
    scored = summed_scores(rows.join(broadcast_if(weights, small), ["question_id", "anchor"]))
    rest = materialise(weights.join(broadcast_if(full, small), "question_id", "left_anti"), "rest")
    if rest.head() is not None:
        scored = scored.unionByName(score_blocks(cut_by_pairs(terms, rest), rest, small))
    return top_blocks(scored, depth)


def summed_scores(hits: DataFrame) -> DataFrame:
    return with_scores(hits.groupBy("block_ordinal", "ordinal_range", "n_terms", "question_id").agg(
        F.sum("fixed_weight").alias("fixed_score"), F.sum("direct").alias("direct_hit_count")))


def with_scores(summed: DataFrame) -> DataFrame:
    """``fixed_score`` as score, and density."""
    score = F.col("fixed_score").cast("double") / F.lit(FIXED_POINT)
    return summed.select("question_id", "block_ordinal", "ordinal_range", "n_terms", "direct_hit_count", score.alias("score"),
                         (score / F.greatest(F.lit(1.0), F.sqrt("n_terms"))).alias("density"))


BLOCK_KEY = ("question_id", "block_ordinal", "ordinal_range", "n_terms")


def direct_hits(postings: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """Blocks that hold a seed, by question: number of seeds and the seeds' part of the score. Reads the seeds' lists only."""
    rows = postings.join(broadcast_if(weights.filter("direct = 1"), small), "anchor")
    return rows.groupBy(*BLOCK_KEY).agg(F.sum("fixed_weight").alias("fixed_score"), F.count("*").alias("direct_hit_count"))


def hit_floors(hits: DataFrame, depth: int) -> DataFrame:
    """(question_id, floor): the direct hits that the first ``depth`` blocks have at least; no row for a question with fewer
    blocks. Counted by number of hits, so no question's blocks are sorted."""
    n = hits.groupBy("question_id", "direct_hit_count").agg(F.count("*").alias("n"))
    down = W.partitionBy("question_id").orderBy(F.desc("direct_hit_count")).rowsBetween(W.unboundedPreceding, 0)
    return (n.withColumn("reach", F.sum("n").over(down)).filter(F.col("reach") >= depth)
            .groupBy("question_id").agg(F.max("direct_hit_count").alias("floor")))


def score_contenders(hits: DataFrame, floors: DataFrame, postings: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """Scored blocks of each question that can stand among its first ``depth``: direct hits come first in the order, so a
    block below the floor cannot, and its other terms are never added up. Questions without a floor take every block that
    holds one of their terms."""
    kept = hits.join(broadcast_if(floors, small), "question_id", "left").filter(F.col("direct_hit_count") >= F.coalesce("floor", F.lit(0))).drop("floor")
    near = postings.join(broadcast_if(weights.filter("direct = 0"), small), "anchor").select(*BLOCK_KEY, F.col("fixed_weight").alias("fixed_score"))
    floored = near.join(broadcast_if(floors.select("question_id"), small), "question_id", "left_semi").join(
        kept.select("question_id", "block_ordinal"), ["question_id", "block_ordinal"], "left_semi")
    rest = near.join(broadcast_if(floors.select("question_id"), small), "question_id", "left_anti")
    none = F.lit(0).cast("bigint").alias("direct_hit_count")
    rows = kept.select(*BLOCK_KEY, "fixed_score", "direct_hit_count").unionByName(floored.select("*", none)).unionByName(rest.select("*", none))
    return with_scores(rows.groupBy(*BLOCK_KEY).agg(F.sum("fixed_score").alias("fixed_score"), F.sum("direct_hit_count").alias("direct_hit_count")))


RANK_KEY = ("direct_hit_count", "density", "score")


def top_blocks(scored: DataFrame, k: int) -> DataFrame:
    """First ``k`` blocks of each question by direct hits, density, score, ordinal. Spark cuts
    each task's rows to ``k`` per question before the exchange (window group limit)."""
    order = W.partitionBy("question_id").orderBy(*[F.desc(c) for c in RANK_KEY], F.asc("block_ordinal"))
    return scored.withColumn("candidate_rank", F.row_number().over(order)).filter(F.col("candidate_rank") <= k)


#: Named blocks of a batch that may be sent to the tasks.
BROADCAST_NAMED = 200_000


def rank_of(scored: DataFrame, wanted: DataFrame, small: bool, named: int = BROADCAST_NAMED) -> DataFrame:
    """Full-depth rank of named blocks, as (question_id, gold_ordinal, full_rank); ``wanted`` holds (question_id,
    block_ordinal).

    The rank keys of the named blocks are looked up first. Few of them go to the tasks, sorted by question: each scored row finds
    by bisection how many named blocks are not behind it, rows are counted by that place, and the counts up to a place give
    its rank; scored rows are neither written nor shuffled. Many of them are placed in order.
    """
    wanted = materialise(wanted.select("question_id", "block_ordinal").distinct(), "wanted")
    if not at_most(wanted, named):
        return placed_ranks(scored, wanted, small)
    key = F.struct(*[(-F.col(c)).alias(c) for c in RANK_KEY], "block_ordinal")
    gold = materialise(scored.join(F.broadcast(wanted), ["question_id", "block_ordinal"], "left_semi").select("question_id", key.alias("key")), "named")
    lists = gold.groupBy("question_id").agg(F.sort_array(F.collect_list("key")).alias("named"))
    most = lists.agg(F.max(F.size("named"))).first()[0] or 0
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))])
    rows = scored.select("question_id", key.alias("key")).join(F.broadcast(lists), "question_id")
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size("named")) & (F.get("named", at + step - 1) <= F.col("key")), at + step).otherwise(at))
    n = rows.groupBy("question_id", place.alias("at")).agg(F.count("*").alias("n"))
    before = n.groupBy("question_id").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    at = lists.select("question_id", F.posexplode("named").alias("i", "key")).join(before, "question_id")
    ahead = F.aggregate(F.filter("counts", lambda c: c["at"] <= F.col("i")), F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    return at.select("question_id", F.col("key.block_ordinal").alias("gold_ordinal"), (ahead + 1).alias("full_rank"))


def placed_ranks(scored: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """``rank_of`` for any number of named blocks.

    All scored rows are range-partitioned by question and rank key and written in that order, so a row's place in its range is
    known; the rows of a question in earlier ranges are added from a table of one count per question and range. No row meets
    another, and no question is sorted in one task.
    """
    rows = materialise(scored.select("question_id", "block_ordinal", *RANK_KEY), "scored")
    placed = number_in_groups(rows, ["question_id"], [*[F.desc(c) for c in RANK_KEY], F.asc("block_ordinal")], "full_rank")
    return placed.join(broadcast_if(wanted.select("question_id", "block_ordinal").distinct(), small), ["question_id", "block_ordinal"]).select(
        "question_id", F.col("block_ordinal").alias("gold_ordinal"), "full_rank")


def fetch_candidates(top: DataFrame, blocks: DataFrame, terms: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """Text, coordinates and matched terms for ranked blocks only. The join also carries the
    blocks table's partition column, so ranges without candidates are not read; terms are the
    stored ones, nothing is tokenised again."""
    held = weights.groupBy("question_id").agg(
        F.sort_array(F.collect_set("anchor")).alias("_all"),
        F.sort_array(F.collect_set(F.when(F.col("direct") == 1, F.col("anchor")))).alias("_direct"))
    # ids and scores alone may be broadcast, and only from a counted batch
    stored = terms.join(broadcast_if(top.select("block_ordinal").distinct(), small), "block_ordinal", "left_semi").select(
        "block_ordinal", F.array_distinct("terms").alias("block_terms"))
    rows = blocks.join(broadcast_if(top, small), ["ordinal_range", "block_ordinal"]).join(stored, "block_ordinal").join(
        broadcast_if(held, small), "question_id")
    meta = ["chat_metadata"] if "chat_metadata" in blocks.columns else []
    return rows.select(
        "question_id", "candidate_rank", "block_ordinal", F.col("marker").alias("citation"), "source_path",
        "line_start", "line_end", tx.round_to(F.col("score"), 4).alias("score"),
        tx.round_to(F.col("density"), 4).alias("density_score"), F.col("n_terms").alias("block_anchor_count"),
        F.col("direct_hit_count"),
        F.sort_array(F.array_intersect("_direct", "block_terms")).alias("direct_matched_anchors"),
        F.sort_array(F.array_intersect("_all", "block_terms")).alias("matched_anchors"),
        "text", "block_terms", *meta)
