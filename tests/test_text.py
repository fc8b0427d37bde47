"""Tokens, blocks, dates and helpers against plain-Python brute force."""

import hashlib
import os
import tracemalloc
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.catalog import queries
from citeloom.catalog.oracle import oracle_sql
from citeloom.catalog.tables import Tables
from citeloom.functions import chat as ch
from citeloom.functions import text as tx
from citeloom.operators import blocks as bl
from citeloom.operators import counts as ct
from citeloom.plans.index import build_index


def brute_anchors(text):
    """One character at a time: an ASCII run may take one apostrophe with a run behind it."""
    ascii_word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in ascii_word:
            j += 1
        if j > i and j + 1 < len(text) and text[j] == "'" and text[j + 1] in ascii_word:
            j += 1
            while j < len(text) and text[j] in ascii_word:
                j += 1
        word = text[i:j or i] if j > i else text[i]
        i = max(j, i + 1)
        word = word.strip().casefold()
        if not any(c.isalnum() for c in word) or word in fv.STOP_TERMS:
            continue
        kinds = {c.isdigit() for c in word}
        if word.isalnum() and word.isascii() and kinds == {True, False}:
            out += list(word)
        elif len(word) > 4 and word[-3:] == "ies":
            out.append(word[:-3] + "y")
        elif len(word) > 3 and word[-1] == "s" and word[-2] != "s":
            out.append(word[:-1])
        else:
            out.append(word)
    return out


CASES = [
    "Studies of cans and boxes; the glass, it's a1's l2cache 2024 x9 rock'n'roll",
    "Geschäft Straße ÜBER naïve œuvre 日本 ½ ²",
    "NASA | table | ? !! --- file files documents Doc's",
    "", "   ", "the a an", "ß ﬁ ſ K ς Σ", "don't can't 'quoted' o'clock's",
]


def run_all(spark, expr, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_anchor_rules(spark):
    assert run_all(spark, tx.anchors, CASES) == [brute_anchors(t) for t in CASES]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAZs'ie 019.-\n\tßéüΣ日|", max_size=40), min_size=20, max_size=40))
def test_anchor_rules_random(spark, texts):
    assert run_all(spark, tx.anchors, texts) == [brute_anchors(t) for t in texts]


def test_expand_keeps_order_and_drops_repeats(spark):
    [got] = run_all(spark, lambda c: tx.expand(tx.anchors(c)), ["harbor cranes harbor ox 7"])
    assert got == ["harbor", "harbors", "crane", "cranes", "ox", "7"]


def brute_blocks(text, width=40):
    out, run, start = [], [], 0
    for n, line in enumerate([*text.splitlines(), ""], 1):
        if line.strip():
            start = start if run else n
            run.append(line)
        elif run:
            out += [(start + k, start + k + len(run[k:k + width]) - 1, "\n".join(run[k:k + width])) for k in range(0, len(run), width)]
            run = []
    return out or ([(1, max(1, len(text.splitlines())), text)] if text else [])


def test_blocks(spark):
    texts = ["one\ntwo\n\nthree\r\nfour\x0bfive\n", "\n\n a \n \t\n b", "", "  \n ", "\n".join(f"line {i}" for i in range(95)), "x\n"]
    got = run_all(spark, tx.text_blocks, texts)
    assert [[tuple(b) for b in g] for g in got] == [brute_blocks(t) for t in texts]


def test_block_ids(spark, docs):
    row = bl.split_documents(docs("alpha\n\nbeta")).orderBy("block_index").collect()[1]
    digest = hashlib.sha1(b"mem/0.txt").hexdigest()
    assert row.block_id == f"{digest}:2" and row.line_start == 3
    assert row.citation_id == "CIT-" + hashlib.sha1(row.block_id.encode()).hexdigest()[:10]


def test_ordinals_are_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit("hot").alias("source"))
    rows = bl.assign_ordinals(df, ["source", "k"], "n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(500))


def test_carry_forward_over_spans(spark):
    rows = [("a", i, f"h{i}" if i in (2, 9) else None) for i in range(14)] + [("b", 0, None), ("b", 1, "z")]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    got = {(r.g, r.i): r.last for r in bl.carry_forward(df, "g", "i", "v", "last", span=3).collect()}
    assert got == {**{("a", i): None if i < 2 else "h2" if i < 9 else "h9" for i in range(14)}, ("b", 0): None, ("b", 1): "z"}


@pytest.mark.parametrize("text,iso", [
    ("1/2/2024 3:04:05 PM", "2024-01-02 15:04:05"), ("01/02/2024 23:04:05", "2024-01-02 23:04:05"),
    ("2024-01-02T03:04:05.500000+0200", "2024-01-02 01:04:05.5"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024-01-02", "2024-01-02 00:00:00"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("soon", None), ("", None)])
def test_chat_timestamp(spark, text, iso):
    assert run_all(spark, lambda c: ch.chat_timestamp(c).cast("string"), [text]) == [iso]


def test_bad_filter_date_is_an_error(spark):
    with pytest.raises(Exception, match="bad date filter"):
        spark.range(1).select(ch.filter_timestamp(F.lit("soon"))).collect()


def test_counts_from_text_equal_counts_from_terms(spark, docs):
    d = docs(*CASES, "cans cans l2cache studies the the")
    got = {r.anchor: r.observations for r in ct.anchor_counts_of_text(d).collect()}
    assert got == dict(Counter(a for r in d.collect() for a in brute_anchors(r.text)))


def test_relations_against_brute_force(spark):
    terms = ["a", "b", "a", "c", "a", "b", "d", "e", "f"]
    df = spark.createDataFrame([(0, terms), (1, ["x"]), (2, [])], "block_ordinal int, terms array<string>")
    want = Counter((terms[i], terms[j], j - i) for i in range(9) for j in range(9) if i != j and abs(i - j) <= 3)
    rel = ct.relation_counts(df, 3)
    got = {(r.anchor, r.neighbor, r.offset): r.observations for r in rel.collect()}
    assert got == want
    total = df.select(ct.relation_total(F.size("terms"), 3).alias("n")).agg(F.sum("n")).head()[0]
    assert total == sum(want.values())
    pairs = {(r.anchor, r.neighbor): (r.observations, r.neighbor_observations) for r in ct.pair_totals(rel, ct.anchor_counts(df)).collect()}
    sums = Counter()
    for (a, b, _), n in want.items():
        sums[a, b] += n
    assert pairs == {k: (n, terms.count(k[1])) for k, n in sums.items()}


def test_forced_symbol_collision(spark):
    lex = spark.createDataFrame([("a", "0x1", 1), ("b", "0x1", 1), ("c", "0x2", 1)], "anchor string, symbol string, observations int")
    with pytest.raises(ValueError, match="collision"):
        ct.assert_no_collisions(lex)
    ct.assert_no_collisions(ct.lexicon(lex.select("anchor", "observations")))


def test_symbols_and_ids(spark):
    [sym] = run_all(spark, tx.symbol, ["crane"])
    assert sym == "0x" + hashlib.sha1(b"crane").hexdigest()[:12].upper()
    assert run_all(spark, tx.normalise_symbol, [" 0xab "]) == ["0xAB"]
    assert run_all(spark, tx.safe_id, [" a b/c. "]) == ["a_b_c"]
    with pytest.raises(Exception, match="id is empty"):
        run_all(spark, tx.safe_id, ["..."])


def test_sentences(spark):
    text = "First one. Second one is longer!\nno stop here\nLast line"
    assert run_all(spark, tx.answer_sentences, [text]) == [["First one.", "Second one is longer!", "Last line"]]
    words = F.array(*[F.lit(w) for w in ("one", "second", "one")])
    assert run_all(spark, lambda c: tx.best_sentence(c, words), [text, "plain\nwords\n", "x."]) == ["Second one is longer!", "words", "x."]
    assert run_all(spark, tx.sentence_case, ["hello  there"]) == ["Hello there."]


def test_evidence_only_and_headers(spark, chat_text):
    [got] = run_all(spark, tx.evidence_only, [chat_text])
    assert "CHAT_" not in got and "harbor crane broke" in got
    assert run_all(spark, lambda c: tx.header_value(c, "CHAT_MESSAGE_ID"), [chat_text]) == ["m1"]
    assert run_all(spark, tx.body_text, ["TITLE: x TEXT: the body "]) == ["the body"]


def test_phrase_positions(spark):
    rows = [(["a", "b", "a", "b", "a"], ["a", "b"]), (["a"], ["a", "b"]), ([], [])]
    df = spark.createDataFrame(rows, "t array<string>, p array<string>")
    assert [r[0] for r in df.select(tx.sequence_positions(F.col("t"), F.col("p"))).collect()] == [[0, 2], [], []]


@pytest.mark.parametrize("chunk,most", [(3, 1), (4, 5), (1 << 19, 1 << 22)])
def test_relations_over_chunk_edges(chunk, most):
    """Pairs are counted by chunks that cut blocks and parts, with null and empty blocks between them."""
    rows = [["a", "b", "a", None, "a", "b", "d"], [], None, ["b"], ["é", "a", "b", "a"], ["a", "a", "a"]] * 3
    window, parts = 3, 5
    want = Counter((r[i], r[j], j - i) for r in rows if r for i in range(len(r)) for j in range(i + 1, min(len(r), i + window + 1)))
    batches = [pa.RecordBatch.from_pydict({"terms": pa.array(rows[s:s + 7], pa.list_(pa.string()))}) for s in range(0, len(rows), 7)]
    counted = pa.Table.from_batches(ct.chunk_counter(window, parts, chunk)(iter(batches)))
    got = Counter()
    for part in range(parts):
        of_part = counted.filter(pc.field("part") == part).combine_chunks().to_batches(max_chunksize=2)
        for out in ct.part_merger(most, 2)(iter(of_part)):
            for r in out.to_pylist():
                assert (r["a"], r["b"], r["o"]) not in got  # a pair lies in one part and stands once
                got[r["a"], r["b"], r["o"]] = r["observations"]
    assert got == want


@pytest.mark.parametrize("chunk,parts", [(3, 5), (1 << 19, 1)])
def test_asked_pairs_over_chunk_edges(chunk, parts):
    """Asked pairs, cut in their part, and totals of asked terms that a bitmap names, against brute force."""
    rows = [["a", "b", "a", None, "a", "b", "d"], [], None, ["b"], ["é", "a", "b", "a"], ["a", "a", "a"]] * 3
    window = 3
    want, totals, later = Counter(), Counter(), set()
    for r in rows:
        for i, x in enumerate(r or []):
            for j, y in enumerate(r):
                if 0 < abs(i - j) <= window:
                    want[x, y, j - i] += 1
                    totals[x, y] += 1
                    later |= {(x, y, j - i)}

    def run(merger, **kind):
        batches = [pa.RecordBatch.from_pydict({"terms": pa.array(rows[s:s + 7], pa.list_(pa.string()))}) for s in range(0, len(rows), 7)]
        counted = pa.Table.from_batches(ct.chunk_counter(window, parts, chunk, **kind)(iter(batches)))
        return [r for part in range(parts) for out in merger(iter(counted.filter(pc.field("part") == part).combine_chunks().to_batches(max_chunksize=2)))
                for r in out.to_pylist()]

    asked, near = pa.array(["a", "é"]), pa.array(["a", "b", "d"])
    got = run(ct.part_merger(2, 2, ct.list_fronts()), asked=asked, near=near, drop=pa.array(["d"]), directed=True)
    assert {(r["anchor"], r["neighbor"], r["offset"]): r["observations"] for r in got} == {
        k: n for k, n in want.items() if k[0] in ("a", "é") and k[1] in ("a", "b")}
    by_rank = lambda k: (-want[k], k[1], k[2])
    first = {k for a in ("a", "é") for o in range(-window, window + 1) for k in sorted((k for k in want if k[0] == a and k[2] == o and k[1]), key=by_rank)[:2]}
    got = run(ct.part_merger(2, 2, ct.list_fronts(first=2, by_offset=True)), asked=asked, near=pa.array(["a", "b", "d", "é"]), directed=True)
    held = {(r["anchor"], r["neighbor"], r["offset"]): r["observations"] for r in got}
    assert first <= set(held) and all(want[k] == n for k, n in held.items()) and (parts > 1 or first == set(held))
    bits = np.zeros(1 << 10, "uint8")
    bits[crc32(b"b") % (1 << 13) >> 3] |= 1 << (crc32(b"b") & 7)
    got = run(ct.part_merger(2, 2, ct.list_fronts(asked=bits.tobytes(), mirrored=True)), asked=bits.tobytes(), offsets=False)
    assert {(r["anchor"], r["neighbor"]): r["observations"] for r in got} == {k: n for k, n in totals.items() if k[0] == "b"}
    sizes = run(ct.part_sizes(2))
    assert (sum(r["relations"] for r in sizes), sum(r["pairs"] for r in sizes)) == (len(want), len(totals))


def test_counting_holds_few_copies_of_its_pairs():
    """A task's memory beside the heap: under 175 bytes a term at the most (about 147; 200 and more with a second copy of the pairs)."""
    rng = np.random.default_rng(3)
    rows = pa.array([[f"w{i}" for i in r] for r in rng.zipf(1.3, (500, 400)).clip(max=20_000)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([rows], ["terms"])
    tracemalloc.start()
    try:
        counted = list(ct.chunk_counter(6, 4, 1 << 20)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(r) for r in counted) == 4 and most < 175 * 200_000


def test_many_asked_terms_are_a_bitmap(spark, monkeypatch):
    """Totals of asked terms do not depend on the bitmap's size; what it lets through goes in the join."""
    terms = spark.createDataFrame([(["w%d" % (i * j % 17) for j in range(60)],) for i in range(20)], "terms array<string>")
    asked = spark.createDataFrame([("w3",), ("w5",), ("zz",), (None,)], "anchor string")
    rows = lambda: sorted(map(tuple, ct.asked_totals(terms, asked).select("anchor", "neighbor", "observations").collect()))
    wide = rows()
    assert {r[0] for r in wide} == {"w3", "w5"}
    monkeypatch.setattr(ct, "ASKED_BITS", 8)
    assert rows() == wide


def test_relations_are_counted_before_the_exchange(spark):
    """What is exchanged follows chunks and parts, not pairs; the query needs no index for it."""
    df = spark.createDataFrame([(["w%d" % (i * j % 17) for j in range(200)],) for i in range(40)], "terms array<string>")
    plan = ct.relation_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition"):]
    assert "MapInArrow" in below and "Generate" not in below and "Aggregate" not in below


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables not present")
def test_relations_need_no_index(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    keys = ("anchor", "neighbor", "offset", "observations")
    from_text = queries.relation_counts(tables)
    assert not tables.holds("docs")
    rows = Counter(tuple(r) for r in from_text.select(*keys).collect())
    assert rows == Counter(tuple(r) for r in build_index(tables.document_rows).relations.select(*keys).collect())
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert rows == Counter(con.execute(f"SELECT anchor, neighbor, \"offset\", observations FROM ({oracle_sql()['relation_counts']})").fetchall())
