"""Ranking, gate, answers, ladder, filters, crosslinks and evaluation on small corpora."""

import math
from collections import Counter, defaultdict

import pytest

from citeloom import fixed_values as fv
from citeloom.operators import answers as an
from citeloom.operators import ranking
from citeloom.plans import ask as ak
from citeloom.plans import crosslink as xl
from citeloom.plans import evaluate as ev
from citeloom.plans import index as ix
from citeloom.plans import receipts as rc

NOISE = "\n".join(f"| crane | row {i} | ? | value {i * 7} |" for i in range(92))
NOTE = "The harbor crane lifts cargo from container ships every morning."


def locations(p):
    return p.locations.orderBy("location_rank").collect()


def test_compact_evidence_beats_noisy_table(index_of):
    got = locations(ak.one_question(index_of(NOISE, NOTE), "Which crane lifts cargo?"))
    assert got[0].text == NOTE and got[0].direct_hit_count >= 2


def test_punctuation_and_stop_terms_never_match(index_of):
    idx = index_of("What is the ? of | it", NOTE)
    rows = ak.one_question(idx, "What is the cargo of it?").candidates.collect()
    assert rows[0].text == NOTE
    assert not {t for r in rows for t in r.matched_anchors} & {"?", "|", "the", "of", "it", "what"}


def test_acronym_is_one_term(index_of):
    rows = ak.one_question(index_of("NASA launched a probe."), "nasa probe").candidates.collect()
    assert rows[0].direct_matched_anchors == ["nasa", "probe"]


def test_broad_heading_is_rejected(index_of):
    p = ak.one_question(index_of("# Overview\n\nOverview of crane cargo handling: cranes lift cargo at the harbor for hours."),
                        "crane cargo overview")
    reasons = {r.text: r.reject_reasons for r in p.qualified.collect()}
    assert "section_heading_ambiguity" in reasons["# Overview"]
    assert [r.text.startswith("Overview of") for r in locations(p)] == [True]


def test_low_coverage_is_refused(index_of):
    p = ak.one_question(index_of("The crane is yellow and was painted again last week by the harbor crew of five."),
                        "Who financed crane insurance reform legislation abroad?")
    assert locations(p) == []
    row = p.answers.head()
    assert row.status == an.REFUSED and row.citations == []
    assert "unsupported_refusal_threshold" in p.qualified.head().reject_reasons
    assert p.ladder.head().support_level == "insufficient"


def test_answer_is_cited(index_of):
    p = ak.one_question(index_of(NOTE + " Nothing else matters."), "crane cargo")
    row = p.answers.head()
    mark = locations(p)[0].citation
    assert row.answer == f"{NOTE} {mark}" and row.citations == [mark]


@pytest.mark.parametrize("text,level,present,absent", [
    ("The crane manual was rejected by the crane crew after review at noon yesterday.", "partial", {"L1", "L6"}, {"L9"}),
    ("The crane script crane.py was executed by the crane crew at noon yesterday.", "strong", {"L3", "L9"}, {"L6"}),
    ("The crane log is in conflict with the crane manual of the crew at noon.", "conflict", {"L8"}, {"L3"})])
def test_ladder(index_of, text, level, present, absent):
    row = ak.one_question(index_of(text), "crane crew").ladder.head()
    assert row.support_level == level and present <= set(row.ladder_hits) and not absent & set(row.ladder_hits)


def test_question_without_terms(index_of, spark):
    idx = index_of(NOTE)
    with pytest.raises(ValueError, match="no anchors"):
        ak.one_question(idx, "what is it?")
    batch = spark.createDataFrame([("a", "what is it?"), ("b", "crane cargo")], "question_id string, question string")
    p = ak.ask(idx, batch)
    row = ak.batch_summary(p, 2.0).head()
    assert (row.question_count, row.completed, row.failed, row.average_seconds) == (2, 1, 1, 1.0)
    assert {r.question_id: r.status for r in p.answers.collect()} == {"a": an.REFUSED, "b": an.ANSWERED}


def brute_rank(blocks, seeds, window=6):
    """Scores of one question, restated over plain lists."""
    counts, pairs = Counter(), defaultdict(int)
    first = {}
    for terms in blocks:
        counts.update(terms)
        for i, a in enumerate(terms):
            for j in range(max(0, i - window), min(len(terms), i + window + 1)):
                if j != i and a in seeds and terms[j] not in seeds and terms[j] not in fv.STOP_TERMS:
                    pairs[terms[j]] += 1
                    first[terms[j]] = min(a, first.get(terms[j], a))
    near = sorted(pairs, key=lambda n: (-pairs[n], first[n], n))[:16]
    weight = {s: 80 for s in seeds} | {n: max(1, 4 - i // 4) for i, n in enumerate(near)}
    rows = []
    for o, terms in enumerate(blocks):
        hit = sorted(set(terms) & set(weight))
        if hit:
            score = sum(weight[t] / math.sqrt(counts[t]) for t in hit)
            rows.append((-len(set(hit) & set(seeds)), -round(score / math.sqrt(len(terms)), 9), -round(score, 9), o))
    return near, [r[-1] for r in sorted(rows)]


def test_ranking_against_brute_force(index_of, spark):
    import random

    rng = random.Random(3)
    vocab = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["zeta", "iota", "crane", "cargo"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    texts = [" ".join(rng.choices(vocab, weights, k=rng.randint(3, 60))) for _ in range(60)]
    idx = index_of(*texts)
    r = ak.rank_blocks(idx, spark.createDataFrame([("q", "wa wd crane")], "question_id string, question string"))
    seeds = r.batch.questions.head().seed_terms
    near, order = brute_rank([t.split() for t in texts], seeds)
    assert [x.neighbor for x in r.neighbors.orderBy("neighbor_rank").collect()] == near
    top = ranking.top_blocks(r.scored, 100).orderBy("candidate_rank").collect()
    assert [x.block_ordinal for x in top] == order
    wanted = spark.createDataFrame([("q", order[7]), ("q", order[0])], "question_id string, block_ordinal long")
    ranks = {x.gold_ordinal: x.full_rank for x in ranking.rank_of(r.scored, wanted, True).collect()}
    assert ranks == {order[7]: 8, order[0]: 1}


def test_scores_use_no_exchange_before_top_k(index_of, spark):
    """With a broadcast question side, blocks are scored where they lie."""
    idx = index_of(*[f"crane cargo {i}" for i in range(20)])
    r = ak.rank_blocks(idx, spark.createDataFrame([("q", "crane")], "question_id string, question string"))
    plan = r.scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block_ordinal" not in plan and "BroadcastHashJoin" in plan
    top = ranking.top_blocks(r.scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top


@pytest.fixture(scope="module")
def chat_index(docs, chat_text):
    return ix.build_index(docs(chat_text), headers=True)


def test_headers_carry_forward(chat_index):
    rows = chat_index.blocks.orderBy("block_ordinal").select("chat_metadata.*").collect()
    assert [r.message_id for r in rows] == ["m1", "m1", "m2", "m3"]
    assert [str(r.date) for r in rows] == ["2024-01-02", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert rows[0].speaker == "user" and rows[0].turn_index == 1 and rows[0].lifetime_allowed is False


@pytest.mark.parametrize("options,ids", [
    ({"speaker": "ASSISTANT"}, {"m2"}), ({"created_after": "2024-01-03T10:00:00Z"}, {"m2", "m3"}),
    ({"created_before": "2024-01-03"}, {"m1"}), ({"created_after": "2024-01-02", "created_before": "2024-01-03", "speaker": "user"}, {"m1"})])
def test_metadata_filter(chat_index, options, ids):
    p = ak.one_question(chat_index, "harbor crane", **options)
    assert {r.chat_metadata.message_id for r in p.candidates.collect()} == ids


def test_bad_filter_fails(chat_index):
    with pytest.raises(Exception, match="bad date filter"):
        ak.one_question(chat_index, "crane", created_after="soon").candidates.collect()


def test_crosslinks(index_of, spark):
    left = index_of("The harbor crane lifts cargo from container ships every morning before sunrise.")
    right = index_of("Container ships bring cargo; a harbor crane unloads it every morning.", "Bread needs flour.")
    batch = spark.createDataFrame([("q", "harbor crane cargo")], "question_id string, question string")
    [link] = xl.link_corpora(left, right, batch).links.collect()
    assert link.shared_anchors == ["cargo", "container", "crane", "every", "harbor", "morning", "ship"]
    assert (link.confidence, link.link_type) == ("partial", "same_evidence_field")


def test_hit_rates(spark):
    ranked = spark.createDataFrame([("a", "d1", 2), ("a", "d2", 1), ("b", "d3", 4), ("c", "d9", 1)], "question_id string, source_path string, r int")
    labels = spark.createDataFrame([("a", "d1"), ("b", "d3"), ("c", "d1")], "question_id string, source_path string")
    got = {x.k: x.hits for x in ev.hit_rates(ev.hits_at(ranked, labels, "r")).collect()}
    assert got == {1: 0, 3: 1, 5: 2, 10: 2}


def test_containment_labels_equal_brute_force(spark):
    passages = ["red crane lifts", "one two three four five six seven", "x", "a b", "cranes lift heavy loads at noon today"]
    texts = ["the red crane lifts it", "zero one two three four five six sevenfold", "big cranes lift heavy loads at noon today!", "a bx", "none"]
    p = spark.createDataFrame([(str(i), t) for i, t in enumerate([*passages, ""])], "question_id string, passage string")
    d = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_path string, text string")
    got = {(r.question_id, r.source_path) for r in ev.containment_labels(p, d, small=True).collect()}
    assert got == {(str(i), f"d{j}") for i, x in enumerate(passages) for j, t in enumerate(texts) if x in t}


def test_receipts_are_stable_and_notice_change(index_of, spark):
    a, b = index_of(NOTE, NOISE), index_of(NOTE, NOISE)
    states = {r.table_name: r.state for r in rc.compare_checksums(rc.index_checksums(a), rc.index_checksums(b)).collect()}
    assert set(states.values()) == {"same"}
    c = index_of(NOTE)
    states = {r.table_name: r.state for r in rc.compare_checksums(rc.index_checksums(a), rc.index_checksums(c)).collect()}
    assert states["blocks"] == "changed"
    p, q = ak.one_question(a, "crane cargo"), ak.one_question(b, "crane cargo")
    assert rc.packet_receipts(p).collect() == rc.packet_receipts(q).collect()
    assert rc.packet_diff(rc.diff_rows(p), rc.diff_rows(q)).head().classification == "identical"
    z = ak.one_question(c, "crane cargo")
    assert rc.packet_diff(rc.diff_rows(p), rc.diff_rows(z)).head().classification == "retrieval_difference"


def test_loaded_index_keeps_its_settings(index_of, spark, tmp_path):
    idx = index_of(NOTE, NOISE, window=2, stop=("crane",))
    again = ix.load_index(spark, ix.save_index(idx, str(tmp_path / "ds")))
    assert (again.window, again.stop) == (2, ("crane",))


def test_save_and_load(index_of, spark, tmp_path):
    idx = index_of(NOTE, NOISE)
    root = ix.save_index(idx, str(tmp_path / "ds"))
    again = ix.load_index(spark, root)
    assert ak.one_question(again, "crane cargo").answers.collect() == ak.one_question(idx, "crane cargo").answers.collect()
    with pytest.raises(FileNotFoundError, match="lacks"):
        ix.load_index(spark, str(tmp_path / "none"))
    p = ak.one_question(idx, "crane cargo")
    ak.write_packets(p, str(tmp_path / "packets"), "r1")
    row = spark.read.parquet(str(tmp_path / "packets")).head()
    assert row.run_id == "r1" and row.locations[0].citation.startswith("[CIT-")


def test_intake_receipt(index_of):
    row = ix.intake_receipt(index_of(NOTE, "a b\n\nc d e")).head()
    assert (row.block_count, row.source_file_count) == (3, 2)
