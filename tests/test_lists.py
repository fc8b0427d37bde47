"""Keyed files, asking by postings, neighbour lists by impact, lookups, symbols and saved layouts."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.operators import blocks as bl
from citeloom.operators import context as cx
from citeloom.operators import counts as ct
from citeloom.operators import filters as fl
from citeloom.operators import lists as ls
from citeloom.operators import lookup, ranking, scan
from citeloom.plans import ask as ak
from citeloom.plans import index as ix
from citeloom.plans import preflight as pf
from citeloom.session import write_bucketed
from citeloom.sources import corpus
from citeloom.sources import large_text as lt
from citeloom.sources import transcripts as tr
from citeloom.sources import watchlists as wl
from citeloom.streaming import intake

QUESTIONS = "question_id string, question string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = [f"w{c}{d}" for c in "abcdefgh" for d in "klmn"] + ["crane", "cargo", "harbor"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return [" ".join(rng.choices(vocab, weights, k=rng.randint(3, 50))) for _ in range(70)]


@pytest.fixture(scope="module")
def parts_of_twenty():
    """Lists cut into parts of 20 rows, so that small corpora have many."""
    held = ls.PART_ROWS
    ls.PART_ROWS = 20
    yield
    ls.PART_ROWS = held


@pytest.fixture(scope="module")
def idx(texts, index_of, parts_of_twenty):
    built = index_of(*texts)
    assert built.posting_lists.fences.count() > 20 and built.neighbor_lists.fences.count() > 20
    return built


@pytest.fixture(scope="module")
def batch(spark):
    """A hot seed, rare ones, one that no block holds, and a question whose seeds fewer blocks hold than are asked for."""
    return spark.createDataFrame([("hot", "wak wal crane"), ("rare", "harbor cargo"), ("none", "zebra"), ("mixed", "zebra harbor whn")], QUESTIONS)


def test_picked_parts_hold_every_row_of_the_keys(idx):
    lists = idx.posting_lists
    hot = lists.rows.groupBy("anchor").count().orderBy(F.desc("count")).first()[0]
    assert len(lists.parts_of([hot])) > 1  # a hot list is cut over parts
    for keys in ([hot], ["crane", "cargo"], ["zzz"], []):
        assert rows_of(lists.pick(keys), "anchor", "block_ordinal", "tf") == rows_of(lists.rows.filter(F.col("anchor").isin(keys)), "anchor", "block_ordinal", "tf")
    assert lists.pick(None).count() == lists.rows.count() == idx.terms.select(F.sum(F.size(F.array_distinct("terms")))).first()[0]


def test_one_question_reads_its_parts_only(idx, spark):
    r = ak.rank_blocks(idx, spark.createDataFrame([("q", "harbor crane")], QUESTIONS))
    keys = [x.anchor for x in r.weights.select("anchor").distinct().collect()]
    parts = idx.posting_lists.parts_of(keys)
    assert 0 < len(parts) < idx.posting_lists.fences.count()
    text = plan(r.postings)
    assert "PartitionFilters: [part" in text or "PartitionFilters: [isnotnull(part" in text
    assert " terms#" not in text and "array<string>" not in text  # postings alone, no scan of the term arrays
    assert "PartitionFilters: [part" in plan(idx.neighbor_lists.pick(["crane"]))
    assert len(idx.neighbor_lists.parts_of(["crane"])) < idx.neighbor_lists.fences.count()


@pytest.mark.parametrize("local_seeds", [20_000, 0])
@pytest.mark.parametrize("depth", [3, 25])
def test_best_blocks_are_those_of_full_scoring(idx, batch, depth, local_seeds, monkeypatch):
    whole = ranking.question_batch
    monkeypatch.setattr(ranking, "question_batch", lambda q, stop: whole(q, stop, local_seeds=local_seeds))
    r = ak.rank_blocks(idx, batch)
    assert r.batch.local == (local_seeds > 0)
    columns = ["question_id", "candidate_rank", "block_ordinal", "direct_hit_count", "score", "density", "n_terms"]
    assert rows_of(r.best(depth), *columns) == rows_of(ranking.top_blocks(r.scored, depth), *columns)
    if depth > 3:
        assert rows_of(r.best(4), *columns) == rows_of(ranking.top_blocks(r.scored, 4), *columns)  # served by the deeper one


def plain_neighbors(idx, batch, limit=16):
    pairs = Counter({(r.anchor, r.neighbor): r.observations for r in idx.pairs.collect()})
    out = []
    for r in batch.questions.collect():
        total, first = Counter(), {}
        for s in sorted(set(r.seed_terms)):
            for (a, n), v in pairs.items():
                if a == s and n not in r.seed_terms and n not in idx.stop:
                    total[n] += v
                    first.setdefault(n, s)
        best = sorted(total, key=lambda n: (-total[n], first[n], n))[:limit]
        out += [(r.question_id, n, total[n], i + 1) for i, n in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1, 4, 16])
@pytest.mark.parametrize("local_seeds", [20_000, 0])
def test_neighbors_by_impact_are_exact(idx, batch, limit, local_seeds):
    asked = ranking.question_batch(batch, idx.stop, local_seeds=local_seeds)
    got = ranking.relation_neighbors(idx.neighbor_lists, idx.list_heads, asked, stop=idx.stop, limit=limit)
    assert rows_of(got, "question_id", "neighbor", "score", "neighbor_rank") == plain_neighbors(idx, asked, limit)


def test_neighbor_lists_are_in_order_of_impact(idx):
    read = idx.neighbor_lists.table.select("part", F.monotonically_increasing_id().alias("at"), "anchor", "observations")
    before = F.lag("observations").over(W.partitionBy("part", "anchor").orderBy("at"))
    assert read.withColumn("b", before).filter("b < observations").count() == 0
    heads = {(r.anchor, r.level): r.entries for r in idx.list_heads.rows.collect()}
    want = Counter((r.anchor, r.observations.bit_length() - 1) for r in idx.pairs.collect() if r.neighbor not in idx.stop)
    assert heads == want


def test_strongest_entries_stop_at_the_level(idx, spark):
    anchors = spark.createDataFrame([("wak",), ("crane",), ("zebra",)], "anchor string")
    got = pf.strongest(idx, anchors, ["wak", "crane", "zebra"], 3, True)
    order = W.partitionBy("anchor").orderBy(F.desc("observations"), "neighbor")
    want = idx.pairs.join(anchors, "anchor").withColumn("item_rank", F.row_number().over(order)).filter("item_rank <= 3")
    assert rows_of(got, "anchor", "neighbor", "item_rank") == rows_of(want, "anchor", "neighbor", "item_rank")


def test_full_ranks_are_places_in_order(idx, batch):
    r = ak.rank_blocks(idx, batch)
    want = {(x.question_id, x.block_ordinal): x.candidate_rank for x in ranking.top_blocks(r.scored, 10**6).collect()}
    gold = r.scored.filter("block_ordinal % 7 = 0").select("question_id", "block_ordinal")
    got = {(x.question_id, x.gold_ordinal): x.full_rank for x in ranking.rank_of(r.scored, gold, False).collect()}
    assert got == {k: v for k, v in want.items() if k[1] % 7 == 0} and len(got) > 10


def test_anchor_blocks_cut_before_positions(idx, spark, texts):
    anchors = spark.createDataFrame([("wak",), ("crane",), ("zebra",)], "anchor string")
    got = rows_of(lookup.anchor_blocks(idx.posting_lists, idx.terms, anchors, 4, keys=["wak", "crane", "zebra"]),
                  "anchor", "block_ordinal", "occurrences", "positions", "block_rank")
    want = []
    for a in ("wak", "crane"):
        held = [(i, [p for p, t in enumerate(x.split()) if t == a]) for i, x in enumerate(texts)]
        held = sorted([h for h in held if h[1]], key=lambda h: (-len(h[1]), h[0]))[:4]
        want += [(a, i, len(p), p, k + 1) for k, (i, p) in enumerate(held)]
    assert got == sorted(want, key=repr)


def test_pretokenised_input_is_asked_by_its_own_tokens(spark):
    """Tokens that the tokenizer would not give: kept upper case, and a text that reads otherwise."""
    df = spark.createDataFrame([(1, ["crane", "Lifts", "a-b"]), (2, ["crane"]), (3, ["other"])], "id int, toks array<string>")
    built = ix.build_index(corpus.from_tokens(df, "id", "toks", "tok"))
    got = {r.source_path: r.block_terms for r in ak.one_question(built, "crane").candidates.collect()}
    assert got == {"tok/1": ["crane", "Lifts", "a-b"], "tok/2": ["crane"]}


def test_colliding_symbols_fail_the_build(index_of):
    with pytest.raises(ValueError, match="symbol collision: 1 symbols.*crab"):
        index_of("crane crab motor", symbol="substring(anchor, 1, 1)")


def test_saved_index_keeps_layout_symbol_and_prefix(spark, index_of, texts, tmp_path):
    built = index_of(*texts[:20], symbol="concat('s-', anchor)", id_prefix="NOTE")
    again = ix.load_index(spark, ix.save_index(built, str(tmp_path / "ds")))
    assert (again.symbol, again.id_prefix) == ("concat('s-', anchor)", "NOTE")
    assert again.lexicon.filter("symbol = 's-wak'").count() == 1
    r = ak.rank_blocks(again, spark.createDataFrame([("q", "wak")], QUESTIONS))
    assert "hashpartitioning(block_ordinal" not in plan(r.scored)  # terms kept their buckets
    assert "PartitionFilters: [part" in plan(r.postings)
    assert rows_of(r.best(5), "block_ordinal", "candidate_rank") == rows_of(
        ak.rank_blocks(built, spark.createDataFrame([("q", "wak")], QUESTIONS)).best(5), "block_ordinal", "candidate_rank")


def test_headers_need_no_exchange(docs, chat_text):
    late = "plain start\n\n" + chat_text
    rows = bl.split_documents(docs(late, "no header at all", ""), headers=True)
    assert "Exchange" not in plan(rows)
    got = [(r.source_path, r.block_index, r.chat_metadata and r.chat_metadata.message_id) for r in rows.orderBy("source_path", "block_index").collect()]
    assert got == [("mem/0.txt", 1, None), ("mem/0.txt", 2, "m1"), ("mem/0.txt", 3, "m1"), ("mem/0.txt", 4, "m2"), ("mem/0.txt", 5, "m3"), ("mem/1.txt", 1, None)]


def test_entries_without_own_terms_go_by_their_anchors(spark, index_of):
    built = index_of("the crane lifts cargo", "it is of the sea", "of the crane", "cargo crane")
    entries = spark.createDataFrame([(0, "of the", "c", "low", ["Sea "]), (1, "", "c", "low", ["crane", "lift"]), (2, "is", "c", "low", ["cargo"]),
                                     (3, "of it", "c", "low", None), (4, None, "c", "low", [" "])],
                                    "source_index int, surface string, class string, severity string, anchors array<string>")
    hits = cx.phrase_hits(built.blocks, built.terms, wl.clean_watchlist(entries), small=True)
    got = {(r.surface, r.block_ordinal): (r.positions, r.matched_width) for r in hits.collect()}
    assert got == {("of the", 1): ([0], 1), ("of the", 2): ([-1], 1), ("crane lift", 0): ([0], 2), ("is", 0): ([2], 1), ("is", 3): ([0], 1)}


def test_underscore_files_are_not_lost_silently(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "_b.txt").write_text("two")
    with pytest.raises(ValueError, match="_b.txt"):
        corpus.scan_text(spark, str(tmp_path))
    assert corpus.scan_text(spark, str(tmp_path), suffixes=[".txt"], unread="skip").count() == 1
    with pytest.raises(ValueError, match="_b.txt"):
        intake.file_stream(spark, str(tmp_path))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "_c.jsonl").write_text("{}")
    with pytest.raises(ValueError, match="_c.jsonl"):
        tr.event_lines(spark, str(tmp_path))
    (tmp_path / "lines" / "_c.jsonl").rename(tmp_path / "lines" / "c.jsonl")
    (tmp_path / "_b.txt").rename(tmp_path / "_b.bin")
    assert corpus.scan_text(spark, str(tmp_path), suffixes=[".txt"]).count() == 1


def test_postings_count_inside_blocks(idx):
    again = idx.posting_lists.rows.groupBy("anchor").agg(F.sum("tf").alias("observations"))
    assert rows_of(again, "anchor", "observations") == rows_of(ct.anchor_counts(idx.terms), "anchor", "observations")


@pytest.fixture(scope="module")
def talk(spark, parts_of_twenty):
    """Messages of three speakers over many ranges; some undated, some without metadata."""
    rng = random.Random(4)
    rows = [(i // 4, i % 4, rng.choice(["user", "Assistant", "tool"]), " ".join(rng.choices(["crane", "cargo", "harbor", "motor"], k=rng.randint(1, 6))),
             None if i % 17 == 0 else f"2024-01-{1 + i // 10:02d} {i % 10:02d}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "conv int, turn int, role string, text string, at string")
    return ix.build_index(corpus.from_messages(df, conversation="conv", turn="turn", role="role", text="text", created_at=F.to_timestamp("at")))


@pytest.mark.parametrize("options", [{"speaker": "user"}, {"created_after": "2024-01-05"}, {"created_before": "2024-01-05"}, {"speaker": " TOOL "},
                                     {"speaker": "assistant", "created_after": "2024-01-03T02:00:00Z", "created_before": "2024-01-12"}, {"speaker": "nobody"},
                                     {"created_after": "2030-01-01"}])
def test_filter_bitmaps_are_the_filtered_blocks(spark, talk, options):
    allowed = fl.allowed_blocks(talk.filters, talk.blocks, **options)
    want = {r.block_ordinal for r in bl.metadata_filter(talk.blocks, **options).collect()}
    assert {r.block_ordinal for r in fl.keep_allowed(talk.blocks.select("block_ordinal"), allowed).collect()} == want
    r = ak.rank_blocks(talk, spark.createDataFrame([("q", "crane motor")], QUESTIONS), **options)
    assert {x.block_ordinal for x in r.best(500).collect()} <= want
    columns = ["candidate_rank", "block_ordinal", "score", "density"]
    assert rows_of(r.best(500), *columns) == rows_of(ranking.top_blocks(r.scored, 500), *columns)


def test_bits_over_bucket_borders(spark):
    ids = [0, 1, 7, 8, 32766, 32767, 32768, 65535, 65536, 10**9]
    held = fl.bitmaps(spark.createDataFrame([(i,) for i in ids], "block_ordinal long"))
    probe = spark.createDataFrame([(i + d,) for i in ids for d in (0, 1, 2)], "block_ordinal long").distinct()
    assert {r[0] for r in fl.keep_allowed(probe, held).collect()} == set(ids)


def test_files_by_ranges_give_the_blocks_of_whole_files(spark, tmp_path):
    rng = random.Random(5)
    bodies = {"a.txt": "one\ntwo\n\nthree\r\nfour\x0bfive\n", "sub/b.md": "\n\n a \n \t\n b", "c.txt": "\n".join(f"line {i} é" for i in range(150)),
              "d.txt": "x\r\r\ny\r\n\r\nz", "e.txt": "", "f.txt": "no break at all " * 40,
              "g.txt": "".join(rng.choice(["word ", "\n", "\n\n", "\r\n", "é ", "\x0c", " ", " "]) for _ in range(900)), "skip.bin": "x"}
    for name, body in bodies.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(body.encode())
    columns = ["source_key", "source_path", "block_index", "block_id", "line_start", "line_end", "text", "citation_id", "marker", "text_hash"]
    whole = rows_of(bl.split_documents(corpus.scan_text(spark, str(tmp_path))), *columns)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        blocks = lt.line_blocks(spark, str(tmp_path))
        lines = lt.numbered_lines(spark, str(tmp_path))
        assert lines.select("source_path", "range_start").distinct().count() > 12
        assert rows_of(blocks, *columns) == whole
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    built = ix.index_blocks(lt.line_blocks(spark, str(tmp_path)))
    assert rows_of(built.counts, "anchor", "observations") == rows_of(ix.build_index(corpus.scan_text(spark, str(tmp_path))).counts, "anchor", "observations")


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\nthree")
    assert [r.text for r in corpus.scan_text(spark, str(tmp_path)).collect()] == ["one\ntwo\n\nthree"]


def test_bad_files_are_set_aside_and_the_batch_goes_on(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "good.txt").write_text("crane cargo")
    (src / "bad.txt").write_bytes(b"crane \xff\xfe\xc3")
    (src / "long.txt").write_text("crane " * 100)
    out = str(tmp_path / "out")
    intake.start_intake(intake.file_stream(spark, str(src)), out, str(tmp_path / "cp"), max_doc_bytes=200).awaitTermination()
    states = {r.source_path.rsplit("/", 1)[1]: (r.state, r.reason) for r in intake.file_states(spark, out).collect()}
    assert states == {"good.txt": ("taken", None), "bad.txt": ("rejected", "invalid_bytes"), "long.txt": ("rejected", "over_size_limit")}
    assert {r.anchor: r.observations for r in intake.total_counts(spark, out).collect()} == {"crane": 1, "cargo": 1}


def test_cloud_keeps_its_radius_in_a_wider_index(index_of):
    from citeloom.operators import frames as fr

    wide, usual = (index_of("a1 b1 c1 d1 e1 f1 g1 h1 i1 crane k1 l1 m1 n1 o1 p1 q1 r1 s1", window=w) for w in (9, 6))
    seeds = usual.counts.filter("anchor = 'crane'").select("anchor")
    columns = ["offset", "neighbor", "observations"]
    got = rows_of(fr.relation_cloud(wide.relations, seeds, small=True), *columns)
    assert got == rows_of(fr.relation_cloud(usual.relations, seeds, small=True), *columns) and {r[0] for r in got} == {*range(-6, 0), *range(1, 7)}


def test_layouts_follow_sizes(spark, docs):
    from citeloom import session as ss

    assert ss.pieces_of(docs("a", "b"), 1, 3, 9) == 3  # size unknown
    written = ss.materialise(spark.range(10_000).withColumn("text", F.sha1(F.col("id").cast("string").cast("binary"))), "sized")
    size = ss.plan_bytes(written)
    assert 100_000 < size < 2_000_000 and ss.plan_bytes(written.join(F.broadcast(written.limit(3)), "id")) < 3 * size  # no product of both sides
    assert ss.pieces_of(written, size // 4, 2, 100) in (4, 5) and ss.pieces_of(written, 1, 2, 100) == 100


@pytest.mark.parametrize("limit", [1, 16])
@pytest.mark.parametrize("most", [3, 20_000])
@pytest.mark.parametrize("local_seeds", [20_000, 0])
def test_neighbors_without_lists_are_exact(idx, batch, limit, most, local_seeds):
    asked = ranking.question_batch(batch, idx.stop, local_seeds=local_seeds)
    got = scan.batch_neighbors(idx.terms, idx.counts, asked, idx.count_list.pick(asked.anchors), stop=idx.stop, limit=limit, most=most)
    assert rows_of(got, "question_id", "neighbor", "score", "neighbor_rank") == plain_neighbors(idx, asked, limit)


def test_one_batch_builds_no_lists(texts, index_of, idx, batch):
    bare = index_of(*texts)
    columns = ["question_id", "candidate_rank", "block_ordinal", "citation", "score", "density_score", "matched_anchors"]
    assert rows_of(ak.ask(bare, batch).candidates, *columns) == rows_of(ak.ask(idx, batch).candidates, *columns)
    assert idx.holds("neighbor_lists") and not any(bare.holds(n) for n in ("relations", "posting_lists", "neighbor_lists", "list_heads"))


@pytest.mark.parametrize("most", [3, 20_000])
def test_lookups_without_lists_are_exact(idx, spark, most):
    from citeloom.operators import frames as fr

    asked = spark.createDataFrame([("wak",), ("crane",), ("harbor",), ("zebra",)], "anchor string")
    columns = ["anchor", "neighbor", "offset", "observations", "neighbor_rank"]
    assert rows_of(lookup.scanned_neighbors(idx.terms, idx.counts, asked, 4, small=True, most=most), *columns) == rows_of(
        lookup.anchor_neighbors(idx.relations, asked, 4), *columns)
    columns = ["anchor", "neighbor", "offset", "observations", "cloud_rank"]
    for small in (True, False):
        assert rows_of(fr.scanned_cloud(idx.terms, idx.counts, asked, small=small, cloud_k=3, most=most), *columns) == rows_of(
            fr.relation_cloud(idx.relations, asked, small=True, cloud_k=3), *columns)
    columns = ["anchor", "neighbor", "observations", "item_rank"]
    for small in (True, False):
        assert rows_of(scan.strongest(idx.terms, idx.counts, asked, 3, small=small, most=most), *columns) == rows_of(
            pf.strongest(idx, asked, ["wak", "crane", "harbor", "zebra"], 3, True), *columns)
    columns = ["anchor", "block_ordinal", "occurrences", "positions", "block_rank"]
    assert rows_of(lookup.scanned_blocks(idx.terms, asked, 4, small=True), *columns) == rows_of(
        lookup.anchor_blocks(idx.posting_lists, idx.terms, asked, 4), *columns)


def test_question_terms_need_no_ranking(spark):
    from citeloom.catalog import queries as catalog
    from citeloom.catalog.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert catalog.question_seeds(t).count() and catalog.question_lexicon(t).count() and catalog.anchor_blocks(t).count()
    assert "packets" not in t.__dict__ and not t.docs.holds("posting_lists")


def test_intake_spreads_batches_and_keeps_terms_alone(spark, tmp_path):
    from citeloom.session import spread

    held = spark.createDataFrame(spark.sparkContext.parallelize([(i, "crane cargo") for i in range(40)], 1), "id int, text string")
    assert held.rdd.getNumPartitions() == 1 and spread(held).rdd.getNumPartitions() > 1  # a frame of unknown size, as a batch is
    src = str(tmp_path / "rows.parquet")
    held.write.parquet(src)
    out = str(tmp_path / "out")
    intake.start_intake(intake.table_stream(spark, src, key="id", text="text", prefix="d"), out, str(tmp_path / "cp"), window=1).awaitTermination()
    assert not (tmp_path / "out" / "relations").exists()
    assert rows_of(intake.total_relations(spark, out), "anchor", "neighbor", "offset", "observations") == [("cargo", "crane", -1, 40), ("crane", "cargo", 1, 40)]


def test_status_and_checksums_need_no_lists(idx, texts, index_of):
    from citeloom.plans import receipts as rc

    bare = index_of(*texts)
    columns = ["table_name", "row_count", "xor_hash", "sum_hash"]
    assert rows_of(rc.index_checksums(bare), *columns) == rows_of(rc.index_checksums(idx), *columns)
    want = {("blocks", idx.blocks.count()), ("terms", idx.terms.count()), ("counts", idx.counts.count()), ("lexicon", idx.lexicon.count()),
            ("relations", idx.relations.count()), ("pairs", idx.pairs.count())}
    assert set(rows_of(rc.dataset_status(bare), "table_name", "row_count")) == want
    assert not any(bare.holds(n) for n in ("relations", "neighbor_lists"))


def test_named_ranks_by_bisection_are_places_in_order(idx, batch):
    r = ak.rank_blocks(idx, batch)
    gold = r.scored.filter("block_ordinal % 5 < 2").select("question_id", "block_ordinal")
    columns = ["question_id", "gold_ordinal", "full_rank"]
    got = ranking.rank_of(r.scored, gold, False)
    assert rows_of(got, *columns) == rows_of(ranking.rank_of(r.scored, gold, False, named=0), *columns)
    assert "repartitionByRange" not in plan(got) and "rangepartitioning" not in plan(got).lower()


def test_phrases_alike_in_the_key_alone_end_in_the_join(spark, index_of, monkeypatch):
    from citeloom.sources import watchlists

    # one that holds the phrase inside longer words, one that has the key's characters only
    built = index_of("the undercrane liftsman came", "a brine lift stood", "crane lifts")
    written = {}
    monkeypatch.setattr(cx, "materialise", lambda df, name: written.setdefault(name, df.localCheckpoint()))
    entries = spark.createDataFrame([(0, "crane lift", "c", "low"), (1, "marine lift", "c", "low")], "source_index int, surface string, class string, severity string")
    hits = cx.phrase_hits(built.blocks, built.terms, watchlists.clean_watchlist(entries), small=True)
    assert sorted((h.surface, h.block_ordinal) for h in hits.collect()) == [("crane lift", 0), ("crane lift", 2)]
    assert written["pairs"].count() == 2


def test_suggestion_pieces_stand_where_a_match_allows(spark, monkeypatch):
    import math
    from difflib import SequenceMatcher

    from citeloom.operators import suggest

    held = suggest.gestalt_ratio

    rng = random.Random(5)
    words = sorted({"c" + "".join(rng.choices("abc", k=rng.randint(3, 9))) for _ in range(160)})
    absent, known = words[::2], words[1::2]
    frame = lambda ws: spark.createDataFrame([(w, 1) for w in ws], "anchor string, observations long")
    best = {(a, k) for a in absent for k in known if abs(len(a) - len(k)) <= fv.SUGGEST_LENGTH_GAP and len(a) >= fv.SUGGEST_MIN_CHARS
            and SequenceMatcher(None, a, k).ratio() >= fv.SUGGEST_MIN_RATIO}
    asked = {(r.anchor, r.candidate) for r in suggest.suggestion_pairs(frame(absent), frame(known)).collect()}
    assert best and best <= asked
    assert "at#" in plan(suggest.suggestion_pairs(frame(absent), frame(known)))  # the place is part of the key
    near = []
    monkeypatch.setattr(suggest, "gestalt_ratio", lambda a, b: near.append((a, b)) or held(a, b))
    fit = lambda a, k: SequenceMatcher(None, a, k).ratio() + min(0.1, math.log1p(1) / 100)
    got = {r.anchor: (r.suggested_anchor, round(r.fit_score, 9)) for r in suggest.suggest_anchors(frame(absent), frame(known)).collect()}
    want = {}
    for a, k in sorted(best):
        if a not in want or fit(a, k) > want[a][1] + 1e-12:
            want[a] = (k, fit(a, k))
    assert got == {a: (k, round(f, 9)) for a, (k, f) in want.items()} and len(near) == 2  # rated in two rounds


def test_tasks_hold_a_bounded_number_of_pairs(spark, texts, index_of, monkeypatch):
    """Without lists: pieces follow blocks times questions, and contenders by direct hits give the first blocks of all pairs."""
    monkeypatch.setattr(ranking, "PAIRS_A_TASK", 20)
    monkeypatch.setattr(ranking, "TERMS_A_TASK", 100)
    built = index_of(*texts)
    asked = spark.createDataFrame([("a", "crane wak wal"), ("b", "cargo"), ("c", "whn crane harbor"), ("d", "unheard"), ("e", "cargo harbor wcl")], QUESTIONS)
    r = ak.rank_blocks(built, asked)
    columns = ("question_id", "block_ordinal", "direct_hit_count", "score", "density", "candidate_rank")
    assert ranking.cut_by_pairs(built.terms, r.damped).rdd.getNumPartitions() >= 14  # 70 blocks, 4 questions with weights
    assert ranking.cut_by_terms(built.terms).rdd.getNumPartitions() > 8
    scored = ranking.score_blocks(built.terms, r.damped, True)
    assert rows_of(r.scored, *columns[:-1]) == rows_of(scored, *columns[:-1])
    for depth in (1, 4, 30, 500):
        for small in (True, False):
            assert rows_of(ranking.best_blocks(built.terms, r.damped, depth, small), *columns) == rows_of(ranking.top_blocks(scored, depth), *columns)
    ids = spark.createDataFrame([("wak",), ("crane",)], "anchor string")
    pairs = scan.asked_relations(built.terms, ids, small=True)
    want = ct.relation_counts(built.terms).filter(F.col("anchor").isin("wak", "crane"))
    assert rows_of(pairs, "anchor", "neighbor", "offset", "observations") == rows_of(want, "anchor", "neighbor", "offset", "observations")
    assert "numPartitions" not in plan(pairs) and "REPARTITION_BY_NUM" in plan(pairs)


def test_packet_diff_counts_neighbours_once(spark, monkeypatch):
    from citeloom.catalog import queries
    from citeloom.catalog.tables import Tables

    asked, count = [], ak.batch_neighbors
    monkeypatch.setattr(ak, "batch_neighbors", lambda *a: asked.append(1) or count(*a))
    queries.packet_diff(Tables(spark, "/root/testdata/sf0.001"))
    assert len(asked) == 1


def test_buckets_follow_bytes(spark, tmp_path):
    """The step that reads most in the index's build: a bucket is read and sorted by one task, so its bytes stay bounded."""
    def noise(batches):
        import os

        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "body": [os.urandom(1 << 18) for _ in range(batch.num_rows)]})
    spark.range(0, 640, 1, 4).mapInArrow(noise, "id bigint, body binary").write.parquet(f"{tmp_path}/rows")
    buckets = write_bucketed(spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/buckets", "id")
    files = [f.stat().st_size for f in (tmp_path / "buckets").glob("part-*")]
    assert sum(files) > 160 << 20 and len(files) == buckets == -(-sum(f.stat().st_size for f in (tmp_path / "rows").glob("part-*")) // (16 << 20))
    assert max(files) < 32 << 20


@pytest.mark.parametrize("pieces", [1_000_000, 0])
def test_suggestions_are_kept_from_the_edit_distance(spark, monkeypatch, pieces):
    """Pairs are those of the gestalt ratio however the pieces meet; words of other letters never come to the edit distance."""
    from difflib import SequenceMatcher

    from citeloom.operators import suggest

    monkeypatch.setattr(suggest, "BROADCAST_PIECES", pieces)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 16)))
    known = sorted({word() for _ in range(150)})
    absent = sorted({k[:i] + rng.choice("abcdeéx") + k[i + rng.randint(0, 2):] for k in known for i in [rng.randint(0, len(k))]} - set(known)) + ["ab"]
    frame = lambda ws: spark.createDataFrame([(w, 1) for w in ws], "anchor string, observations long")
    pairs = suggest.suggestion_pairs(frame(absent), frame(known))
    got = {(r.anchor, r.candidate) for r in pairs.collect()}
    want = {(a, k) for a in absent for k in known if a[0] == k[0] and abs(len(a) - len(k)) <= fv.SUGGEST_LENGTH_GAP
            and len(a) >= fv.SUGGEST_MIN_CHARS and SequenceMatcher(None, a, k).ratio() >= fv.SUGGEST_MIN_RATIO}
    assert len(want) > 40 and want <= got
    assert "bit_count" in plan(pairs) and ("SortMergeJoin" in plan(pairs)) == (pieces == 0)


@pytest.mark.parametrize("small", [True, False])
def test_phrases_are_met_as_numbers(spark, index_of, monkeypatch, small):
    """Rows between the steps of a phrase search hold a block and an entry's number; entries may share their source index."""
    written, keep = {}, cx.materialise
    monkeypatch.setattr(cx, "materialise", lambda df, name: written.setdefault(name, df.columns) and keep(df, name))
    built = index_of("the crane lifts cargo here", "no crane lifts", "cargo crane  lifts cargo")
    entries = spark.createDataFrame([(7, "crane lifts", "c", "low"), (7, "lifts cargo", "d", "high"), (8, "cargo", None, "low")],
                                    "source_index int, surface string, class string, severity string")
    hits = cx.phrase_hits(built.blocks, built.terms, wl.clean_watchlist(entries), small=small)
    assert rows_of(hits, "source_index", "surface", "class", "block_ordinal", "positions") == sorted([
        (7, "crane lifts", "c", 0, [0]), (7, "crane lifts", "c", 1, [1]), (7, "crane lifts", "c", 2, [1]), (7, "lifts cargo", "d", 0, [1]),
        (7, "lifts cargo", "d", 2, [2]), (8, "cargo", None, 0, [2]), (8, "cargo", None, 2, [0, 3])], key=repr)
    assert written["pairs"] == written["phrases"] == ["block_ordinal", "entry"]


def test_both_passes_share_their_clouds(spark, idx, monkeypatch):
    """Pairs are counted once for the seeds of both passes; each pass's frames are those of its own seeds' clouds."""
    from citeloom.plans import frames as fp

    counted, cloud = [], fp.seed_cloud
    monkeypatch.setattr(fp, "seed_cloud", lambda *a, **k: counted.append(1) or cloud(*a, **k))
    rows = [("a", "crane wak", "cargo"), ("b", "cargo wal", "harbor whn"), ("c", "harbor", None)]
    asked = spark.createDataFrame(rows, "question_id string, question string, mirror_starter string")
    columns = ("question_id", "frame_rank", "block_ordinal", "score", "anchor_windows")
    found = fp.speak(idx, asked).frames
    assert len(counted) == 1
    plain = fp.speak(idx, asked.drop("mirror_starter")).frames
    assert rows_of(found.filter(F.col("pass") == "question"), *columns) == rows_of(plain, *columns)
    assert {r[0] for r in found.filter(F.col("pass") != "question").select("question_id").collect()} == {"a", "b"}
