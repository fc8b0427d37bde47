"""Watchlists, preflight, reform, frames, rounds, vocabulary, routing, sources, streaming."""

import json
from collections import Counter
from difflib import SequenceMatcher
from itertools import product

import pytest
from pyspark.sql import functions as F

from citeloom.operators import context as cx
from citeloom.operators import counts as ct
from citeloom.operators import frames as fr
from citeloom.operators import suggest
from citeloom.operators import vocabulary as vc
from citeloom.plans import ask as ak
from citeloom.plans import frames as fp
from citeloom.plans import index as ix
from citeloom.plans import preflight as pf
from citeloom.plans import reform as rf
from citeloom.plans import rounds as rd
from citeloom.plans import routing as rt
from citeloom.plans import watch as wt
from citeloom.sources import corpus
from citeloom.sources import questions as qs
from citeloom.sources import transcripts as tr
from citeloom.sources import watchlists as wl
from citeloom.streaming import intake

NOTE = "The harbor crane lifts cargo from container ships every morning."


@pytest.fixture(scope="module")
def chat(docs, chat_text):
    return ix.build_index(docs(chat_text), headers=True)


# -- watchlists -------------------------------------------------------------------------

def test_special_search(chat, spark):
    entries = spark.createDataFrame([(0, "Cranes", "tool"), (1, "harbor", "place"), (2, "crane", "again"), (3, "two words", "x")],
                                    "source_index int, surface string, class string")
    run = wt.special_search(chat, entries)
    assert [(r.anchor, r["class"]) for r in run.entries.orderBy("source_index").collect()] == [("crane", "tool"), ("harbor", "place")]
    assert run.unmatched.head().reason == "not_a_solo_anchor"
    hits = {(r.anchor, r.block_ordinal) for r in run.hits.collect()}
    assert hits == {("crane", 0), ("crane", 2), ("crane", 3), ("harbor", 0), ("harbor", 1), ("harbor", 3)}
    records = {(r.source_index, r.block_ordinal): r for r in cx.expanded_records(run.around, ["source_index", "block_ordinal"]).collect()}
    middle = records[0, 2]
    assert [b.block_ordinal for b in middle.previous_blocks] == [1] and [b.block_ordinal for b in middle.next_blocks] == [3]
    events = run.events.orderBy("event_id").collect()
    assert len(events) == 6 and events[0].event_id == "tcg-000001" and events[0].confidence == 0.0 and events[0].needs_review
    n = {(r.measure, r.key, r["item"]): r.n for r in run.counts.collect()}
    assert n["trigger_to_role_counts", "crane", "user"] == 2 and n["anchor_class_counts", "", "tool"] == 3
    assert wt.run_receipt(run).head().hits == 6


def test_hit_caps(chat, spark):
    entries = spark.createDataFrame([(0, "crane", "t"), (1, "harbor", "t")], "source_index int, surface string, class string")
    assert wt.special_search(chat, entries, max_hits=0).hits.count() == 2
    run = wt.trigger_run(chat, entries.withColumn("severity", F.lit("low")), max_total=4)
    assert [(r.source_index, r.block_ordinal) for r in run.hits.orderBy("source_index", "block_ordinal").collect()] == [(0, 0), (0, 2), (0, 3), (1, 0)]
    dated = wt.trigger_run(chat, entries, date="2024-01-03")
    assert {r.block_ordinal for r in dated.hits.collect()} == {2} and dated.around.count() == 1


def test_event_terms_are_counted_inside_the_row(spark):
    """Terms around hits were exploded, shuffled and sorted; with one block a side the row holds all that is counted."""
    texts = [["bb", "aa", "cc", "bb", "x", "aa", "the", "bb"], [], None, ["dd"] * 3 + [f"t{i:02d}" for i in range(40)], ["zz", "aa", "zz", "a"]]
    rows = [(s, b, d, side, "crane", "praise", (b + d, texts[(b + d) % len(texts)], "2024-01-02", "user", "m", "id"))
            for s, b in ((1, 10), (1, 13), (2, 13)) for d, side in ((-1, "prior"), (0, "hit"), (1, "next"))]
    ctx = "struct<block_ordinal: long, terms: array<string>, date: string, speaker: string, marker: string, block_id: string>"
    around = spark.createDataFrame(rows, f"source_index int, block_ordinal long, distance int, side string, anchor string, class string, ctx {ctx}")
    around = around.withColumn("ctx", F.col("ctx").withField("created_at", F.lit("2024-01-02")))
    for shaped in (False, True):
        inside = cx.event_rows(around, shaped=shaped, single=True)
        assert sorted(map(str, inside.collect())) == sorted(map(str, cx.event_rows(around, shaped=shaped).collect()))
    keys = ["source_index", "block_ordinal"]
    assert "explode" in cx.top_context(around, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in cx.top_context(around, keys, single=True)._jdf.queryExecution().optimizedPlan().toString()


def test_phrase_hits_equal_brute_force(spark, docs):
    texts = ["Do not  undo nothing", "we must do not", "plain talk", "of the", "stop it now", "a b c", "xdo notx y", "NOW"]
    surfaces = ["do not", "of the", "now", "stop it", "b c", "a b c", "it now", "plain", "o n"]
    idx = ix.build_index(docs(*texts))
    watch = wl.clean_watchlist(spark.createDataFrame([(i, s, "c", "low") for i, s in enumerate(surfaces)],
                                                     "source_index int, surface string, class string, severity string"))
    got = {(r.surface, r.block_ordinal) for r in cx.phrase_hits(idx.blocks, idx.terms, watch, small=True).collect()}
    want = {(s, i) for s, (i, t) in product(surfaces, enumerate(texts)) if len(s.split()) > 1 and s in " ".join(t.lower().split())}
    want |= {("now", 4), ("now", 7), ("plain", 2)}
    # phrases that leave no anchor at all cannot be searched
    assert got == {w for w in want if w[0] not in ("of the",)}
    rows = {(r.surface, r.block_ordinal): (r.positions, r.matched_width) for r in cx.phrase_hits(idx.blocks, idx.terms, watch, small=True).collect()}
    assert rows["do not", 0] == ([0], 1) and rows["stop it", 4] == ([0], 1)


def test_watchlist_split_and_triggers(spark, tmp_path):
    rows = spark.createDataFrame([(0, " No  Way ", "a"), (1, "no way", "b"), (2, "Stop", "c")], "source_index int, surface string, class string")
    watch = wl.clean_watchlist(rows)
    assert {r.surface for r in wl.phrase_entries(watch).collect()} == {"no way"} and wl.solo_entries(watch).head().surface == "stop"
    assert wl.phrase_entries(watch).head()["class"] == "a"
    path = tmp_path / "t.json"
    for body in (["crane", {"surface": "Harbor", "class": "place"}], {"anchors": ["crane", {"phrase": "Harbor", "class": "place"}]},
                 {"entries": [{"anchor": "crane"}, {"text": "Harbor", "class": "place"}]}):
        path.write_text(json.dumps(body))
        got = [(r.surface, r["class"]) for r in wl.read_triggers(spark, str(path)).orderBy("source_index").collect()]
        assert got == [("crane", "special_search"), ("Harbor", "place")]
    path.write_text(json.dumps({"anchor": "crane", "source_surfaces": ["cranes", "big crane"]}))
    _, unmatched = wl.split_triggers(wl.read_triggers(spark, str(path)))
    assert [(r.surface, r.reason) for r in unmatched.collect()] == [("big crane", "source_surface_not_solo_anchor")]


# -- preflight and reform ---------------------------------------------------------------

def test_suggestions_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    known = sorted({"".join(rng.choices("abcdef", k=rng.randint(3, 14))) for _ in range(300)})
    def bend(w):
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(1, len(w))
            w = w[:at] + rng.choice(("", rng.choice("abcdef"))) + w[at + rng.randint(0, 1):]
        return w
    absent = sorted({bend(w) for w in known} - set(known))
    counts = {w: rng.randint(1, 50) for w in known}
    a = spark.createDataFrame([(w,) for w in absent], "anchor string")
    k = spark.createDataFrame(list(counts.items()), "anchor string, observations long")
    import math
    want = {}
    for w in absent:
        best = min(((-(r + min(0.1, math.log1p(counts[c]) / 100)), c) for c in known if c[0] == w[0] and abs(len(c) - len(w)) <= 3
                    for r in [SequenceMatcher(None, w, c).ratio()] if r >= 0.86), default=None)
        if best:
            want[w] = best[1]
    got = {r.anchor: r.suggested_anchor for r in suggest.suggest_anchors(a, k).collect()}
    assert want and got == want


def test_preflight(index_of, spark):
    idx = index_of(NOTE, "Container terminal cranes move containers; terminal crews watch the crane.")
    batch = spark.createDataFrame([("ok", "crane cargo"), ("fix", "Containr cargo"), ("odd", "zebra cargo"), ("none", "what is it?")],
                                  "question_id string, question string")
    rows = {r.question_id: r for r in pf.preflight(idx, batch).collect()}
    assert rows["ok"].approved and rows["ok"].status == "approved_unchanged" and rows["ok"].coverage == 1.0
    assert rows["fix"].suggested_question == "Container cargo" and rows["fix"].status == "suggested_reshape"
    assert rows["odd"].requires_review and rows["odd"].absent_anchors == ["zebra"] and rows["odd"].coverage == 0.5
    assert rows["none"].requires_review and not rows["none"].approved
    assert "crane" not in [e.neighbor for e in rows["ok"].expected]
    s = pf.preflight_summary(pf.preflight(idx, batch)).head()
    assert (s.questions, s.approved, s.changed, s.review) == (4, 1, 1, 2)


def test_reform(index_of, spark):
    idx = index_of("CHAT_MESSAGE_ID: m7\nTITLE: t TEXT: Crane 42 lifts container cargo daily. Other matters follow here.")
    p = ak.one_question(idx, "crane 42 lifts container cargo")
    row = ("q1", "crane 42 lifts container cargo", None, "an answer", "answered", True, True)
    schema = ("question_id string, original_question string, suggested_question string, answer string, status string, original_hit boolean, "
              "suggested_hit boolean")
    none = spark.createDataFrame([], "question_id string, low_fit_anchors array<string>")
    cases = [(row, "CLEAN_SUPPORTED_ANSWER"), ((*row[:5], True, False), "BENCHMARK_MISMATCH"), ((*row[:4], "not_enough_information", True, True), "NO_SUPPORT_FOUND")]
    for values, form in cases:
        got = rf.reform(spark.createDataFrame([values], schema), p.locations, none).head()
        assert got.form == form
    rec = rf.reform(spark.createDataFrame([row], schema), p.locations, none)
    trace, readable = rf.trace_and_readable(rec)
    assert readable.head().answer.startswith("Crane 42 lifts container cargo daily. [CIT-") and readable.head().start_message_id == "m7"
    assert trace.head().snippets[0].snippet_score == 5 + 3
    assert rf.form_counts(rec).head().n == 1


# -- frames and rounds ------------------------------------------------------------------

def test_windows(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "b"], ["b", "d"])], "t array<string>, f array<string>")
    got = df.select(fr.term_windows(F.col("t"), F.col("f"), 2).alias("w")).head().w
    assert [(w.position, w.center, w.before, w.after) for w in got] == [
        (1, "b", ["a"], ["c", "d"]), (3, "d", ["b", "c"], ["b"]), (4, "b", ["c", "d"], [])]


def test_frames_and_mirror(index_of, spark):
    idx = index_of(NOTE, "Bread needs flour and water.")
    batch = spark.createDataFrame([("q", "crane cargo", "bread is baked from flour"), ("r", "crane cargo", None)],
                                  "question_id string, question string, mirror_starter string")
    s = fp.speak(idx, batch, top_k=1)
    rows = {r.question_id: r for r in s.answers.collect()}
    assert rows["q"].evidence_pass == "mirror_answer_starter" and rows["q"].answer.startswith("Bread is baked from flour. [CIT-")
    assert rows["r"].status == "answered_from_evidence" and rows["r"].answer.startswith(NOTE)
    assert all(f.frame_id.startswith("FRAME-") for f in s.frames.collect())


def test_event_ids_and_suggestions_are_not_cut(spark):
    from pyspark.sql import functions as F
    from citeloom.operators.suggest import apply_suggestions
    long = "a" * 1200
    out = spark.range(1).select(
        F.format_string("tcg-%06d", F.lit(1234567)).alias("id"),
        apply_suggestions(F.lit(long.capitalize()), F.array(F.struct(F.lit(long).alias("raw"), F.lit("b" * 1100).alias("new")))).alias("q")).head()
    assert out.id == "tcg-1234567" and out.q == ("b" * 1100).capitalize()


def test_table_stream_reads_a_folder(spark, tmp_path):
    from citeloom.streaming import intake
    folder = str(tmp_path / "docs.parquet")
    spark.range(6).selectExpr("id as k", "'é words' as body").repartition(3).write.parquet(folder)
    for path in (folder, f"{folder}/part-*.parquet"):
        stream = intake.table_stream(spark, path, key="k", text="body", prefix="p")
        query = stream.writeStream.format("memory").queryName(f"t{len(path)}").option("checkpointLocation", str(tmp_path / f"c{len(path)}")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.table(f"t{len(path)}").collect()
        assert len(rows) == 6 and {r.file_bytes for r in rows} == {8}


def test_every_seed_is_asked(chat, spark):
    seeds = spark.createDataFrame([(i, f"harbor crane trouble number {i}") for i in range(60)], "seed_at int, question string")
    run = rd.run_rounds(chat, seeds, max_records=10)
    assert sorted(r.place for r in run.attempts.collect()) == list(range(1, 61))
    deep = rd.run_rounds(chat, seeds.limit(2), max_depth=1).attempts.collect()
    assert {r.depth for r in deep} == {0, 1} and sorted(r.place for r in deep) == list(range(1, len(deep) + 1))


def test_rounds(chat, spark):
    seeds = spark.createDataFrame([(1, "harbor crane trouble"), (2, "zebra stripes")], "seed_at int, question string")
    run = rd.run_rounds(chat, seeds, vocabulary=vc.build_vocabulary(chat.lexicon), max_records=5)
    rows = run.attempts.orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3, 4, 5] and [r.depth for r in rows] == [0, 0, 1, 1, 2]
    assert rows[0].passed and not rows[1].passed and "missing_citation" in rows[1].failure_types
    assert rows[2].question.startswith("Which cited lines tie") and rows[2].parent_id == rows[0].question_id
    assert run.failures.count() == run.corrections.count() >= 1
    kinds = {r.link_type for r in run.links.collect()}
    assert kinds == {"content", "idea", "context"}
    assert run.summary.head().attempts == 5 and rd.packets(run).head().packet_index == 1


def test_grading_rules(spark):
    rows = spark.createDataFrame([("a", "This proves it, as an AI.", ["crane"], ["[c]"], 1), ("b", "", [], [], 0), ("c", "Fine text.", ["crane"], ["[c]"], 1)],
                                 "question_id string, answer string, major_anchors array<string>, citations array<string>, frame_count int")
    got = {r.question_id: r.failure_types for r in rd.grade(rows).collect()}
    assert got["a"] == ["outside_dataset_boundary", "evidence_speech_boundary_leak"] and got["c"] == []
    assert got["b"] == ["bad_answer_frame", "missing_citation", "weak_crossing", "missing_variables"]


# -- vocabulary and routing -------------------------------------------------------------

def test_vocabulary(spark):
    lex = spark.createDataFrame([("crane", "0x1", 3), ("never", "0x2", 1), ("and", "0x3", 2), ("b2", "0x4", 1)], "anchor string, symbol string, observations long")
    v = vc.build_vocabulary(lex)
    terms = spark.createDataFrame([(t,) for t in ("Crane", "never", "and", "the", "zebra", "b2", " ", "supports")], "term string")
    got = {r.term: (r.allowed, r.meaningful, r.reason) for r in vc.surface_decisions(terms, v).collect()}
    assert got["Crane"] == (True, True, "observed_anchor") and got["never"] == (False, False, "forbidden_claim_term")
    assert got["and"] == got["the"] == (True, False, "allowed_glue") and got["zebra"] == (False, False, "not_observed_and_not_glue")
    assert got[" "][2] == "empty_surface"
    paths = spark.createDataFrame([("p", ["crane", "b2"], ["[c]", "[c]"]), ("q", ["crane", "zebra"], ["[c]"]), ("r", [], [])],
                                  "path_id string, terms array<string>, citations array<string>")
    out = {r.path_id: r for r in vc.assemble_paths(paths, v).collect()}
    assert out["p"].surface == "crane and b2. [c]" and out["q"].refusal_reason == "unsupported_meaning_anchor:zebra"
    assert out["r"].status == "not_enough_evidence"
    assert vc.relation_phrase("Related") == "is related to"


def test_paths_make_their_terms_once(spark):
    """The terms of every text were made anew for the decisions, for their filter and for the sentences."""
    v = vc.build_vocabulary(spark.createDataFrame([("crane", "0x1", 3)], "anchor string, symbol string, observations long"))
    paths = spark.createDataFrame([("p", "crane  crane"), ("q", "crane zebra")], "path_id string, text string").select(
        "path_id", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("terms"), F.array(F.lit("[c]")).alias("citations"))
    out = vc.assemble_paths(paths, v)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.path_id: r.refusal_reason for r in out.collect()} == {"p": None, "q": "unsupported_meaning_anchor:zebra"}


def test_phrases_are_searched_before_patterns_run(spark):
    phrases = ["now", "can't", "c++", "a b", "é"]
    texts = ["now", "snow", "now's", "can't", "c++ now", "xc++", "xa by", "é", "né", "", None, "_now", "now_ now"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rt.phrases_present(F.col("t"), phrases).alias("found"))
    assert [r.found for r in df.collect()] == [["now"], [], [], ["can't"], ["now", "c++"], [], ["a b"], ["é"], [], [], [], [], ["now"]]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Contains(") == len(phrases)


@pytest.mark.parametrize("text,mode", [
    ("This is garbage, delete everything!", "DESTRUCTIVE_COMMAND_LOCK"), ("Run it now", "AMBIGUITY_MODE"),
    ("I am fed up with this garbage", "VENT_MODE"), ("Back up my project dataset folder", "SYSTEM_COMMAND_MODE"),
    ("What evidence backs the claim", "EVIDENCE_AUDIT_MODE"), ("Open the branch folder", "TASK_MODE"), ("runner's snow", "VENT_MODE")])
def test_routing(spark, text, mode):
    row = rt.route_messages(spark.createDataFrame([(text,)], "text string")).head()
    assert row["mode"] == mode and row.action_state == "AUDIT_ONLY"


# -- sources ----------------------------------------------------------------------------

def test_text_scan_and_policy(spark, tmp_path):
    for name, body in (("b/x.TXT", "one"), ("a.md", "two"), ("b.c/y.txt", "three"), (".git/z.txt", "no"), ("skip.bin", "no")):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(body)
    rows = corpus.scan_text(spark, str(tmp_path)).orderBy("source_key").collect()
    assert [r.text for r in rows] == ["two", "one", "three"]
    kept, rejected = corpus.apply_size_policy(corpus.scan_files(spark, str(tmp_path)), 3, "skip")
    assert [r.reason for r in rejected.collect()] == ["file_exceeds_max_size"] and kept.count() == 3


def test_pretokenised_input(spark):
    df = spark.createDataFrame([(1, ["x", "Y"]), (2, ["x"])], "id int, toks array<string>")
    idx = ix.build_index(corpus.from_tokens(df, "id", "toks", "tok"))
    assert {r.anchor: r.observations for r in idx.counts.collect()} == {"x": 2, "Y": 1}


def test_question_sources(spark, tmp_path):
    f = tmp_path / "q.txt"
    f.write_text("first?\n\n  second?  \n")
    assert [r.question for r in qs.question_lines(spark, str(f)).orderBy("question_id").collect()] == ["first?", "second?"]
    assert qs.question_list(spark, ["zero?"], str(f)).count() == 3
    mixed = spark.createDataFrame([("# note",), ('{"question": "j?", "mirror_answer_starter": "m"}',), ("t?\tstart",), ("p?",), ("",)], "line string")
    assert {(r.question, r.mirror_starter) for r in qs.mixed_questions(mixed).collect()} == {("j?", "m"), ("t?", "start"), ("p?", None)}
    m = tmp_path / "map.json"
    m.write_text(json.dumps({"test_queries": [{"query_id": "7", "question": "x?", "line_number": 3}]}))
    assert qs.benchmark_map(spark, str(m)).head().question_id == "7"
    m.write_text(json.dumps({"test_queries": [{"query_id": "7"}]}))
    with pytest.raises(Exception, match="lacks question"):
        qs.benchmark_map(spark, str(m)).collect()


def test_session_staging(spark, tmp_path):
    say = lambda role, *parts, when="": {"type": "response_item", "timestamp": when, "payload": {"type": "message", "role": role, "content": list(parts)}}
    (tmp_path / "a.jsonl").write_text("\n".join([
        json.dumps({"type": "session_meta", "payload": {"id": "s1", "source": "cli"}}), "{broken",
        json.dumps(say("User", {"text": "hello"}, {"value": "there"}, when="2024-01-02")), json.dumps(say("system", {"text": "x"})),
        json.dumps({"type": "event", "payload": {}}), json.dumps(say("assistant", {"text": "  "})), json.dumps(say("assistant", {"text": "hi"}, when="2024-01-03"))]))
    (tmp_path / "b.jsonl").write_text(json.dumps(say("user", {"text": "alone"})))
    index = spark.createDataFrame([(0, '{"id": "s1", "thread_name": "old"}'), (1, '{"id": "s1", "thread_name": "Talk"}')], "line_no int, line string")
    turns = tr.stage_sessions(tr.event_lines(spark, str(tmp_path)), tr.session_titles(index))
    rows = turns.orderBy("turn_number").collect()
    assert [(r.turn_number, r.conversation_id, r.title, r.speaker, r.text, r.scope) for r in rows] == [
        (1, "s1", "Talk", "user", "hello\nthere", "cli"), (2, "s1", "Talk", "assistant", "hi", "cli"), (3, "b", "b", "user", "alone", "session")]
    r = tr.staging_receipt(turns).head()
    assert (r.turn_count, r.session_count, r.user_turns, r.earliest_timestamp, r.latest_timestamp) == (3, 2, 2, "2024-01-02", "2024-01-03")
    text = tr.render_turns(turns, "sessions").orderBy("turn_number").head().turn_text
    assert text.startswith("## CHAT_TURN_1\n") and text.endswith("hello\nthere")


def test_markdown_staging(spark):
    text = ("# My talk\n\n## Source Metadata\n- Session id: `s9`\n- Originator: cli\n\n## Turns\n\n### 1. User\n\nTimestamp: `2024-01-01`\n\nFirst\n\nmore\n\n---\n\n"
            "### 2. Assistant\n\nNo stamp here\n\n### 3. User\n\nTimestamp: x\n\n\n")
    rows = tr.stage_markdown(spark.createDataFrame([("/m/x.md", text)], "source_path string, text string")).orderBy("turn_number").collect()
    assert [(r.speaker, r.created_at, r.text) for r in rows] == [("user", "2024-01-01", "First\n\nmore"), ("assistant", "", "No stamp here")]
    assert {(r.conversation_id, r.title, r.scope) for r in rows} == {("s9", "My talk", "cli")}


# -- streaming --------------------------------------------------------------------------

def test_incremental_equals_batch(spark, tmp_path, index_of):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    (src / "a.txt").write_text(NOTE + "\n\nCrane again")
    (src / "b.txt").write_text("cargo cargo crane")
    run = lambda: intake.start_intake(intake.file_stream(spark, str(src), max_files=1), out, chk, max_doc_bytes=1000).awaitTermination()
    run()
    (src / "c.txt").write_text("late cargo")
    (src / "big.txt").write_text("x " * 900)
    run()
    run()  # nothing new: finished batches are skipped
    idx = index_of(NOTE + "\n\nCrane again", "cargo cargo crane", "late cargo")
    as_set = lambda df, *c: {tuple(r[k] for k in c) for r in df.collect()}
    assert as_set(intake.total_counts(spark, out), "anchor", "observations") == as_set(idx.counts, "anchor", "observations")
    keys = ("anchor", "neighbor", "offset", "observations")
    assert as_set(intake.total_relations(spark, out), *keys) == as_set(idx.relations, *keys)
    totals = intake.run_totals(spark, out).head()
    assert (totals.batches, totals.sources, totals.relation_observations) == (4, 3, idx.relations.agg(F.sum("observations")).head()[0])
    assert [r.reason for r in spark.read.parquet(out + "/rejected").collect()] == ["over_size_limit"]


def test_counts_add_up(spark, index_of):
    a, b, both = index_of(NOTE), index_of("cargo ships"), index_of(NOTE, "cargo ships")
    merged = ct.merge_counts(a.counts, b.counts, keys=["anchor"])
    assert Counter(map(tuple, merged.select("anchor", "observations").collect())) == Counter(map(tuple, both.counts.select("anchor", "observations").collect()))
