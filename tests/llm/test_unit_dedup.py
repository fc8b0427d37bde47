"""Removed spans against a single pass in order of doc_id and position."""

from citeloom.llm import unit_dedup as ud
from citeloom.llm.jaccard_join import keyed


def brute(rows, line_words, block_words):
    seen, out = set(), {}
    for d, text in sorted(rows):
        spans = sorted((a, b) for a, b, h in sorted(ud.units(text, line_words, block_words)) if h in seen or seen.add(h))
        merged = []
        for a, b in spans:
            if merged and merged[-1][1] >= a:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out[d] = merged
    return out


def test_spans_match_single_pass(docs_of, words):
    passage = ". ".join(words(8).capitalize() for _ in range(8)) + "."
    line = words(14)
    rows = [(i, f"{words(30)} {passage} {words(25)}\n{words(9)}.\n{line}\n{words(40)}. é") for i in range(12)]
    rows += [(20, line + "\n" + line), (21, passage), (22, "short line\nshort line")]
    got = {r.doc_id: ([(s.start, s.end) for s in r.removed], r.text, r.n_removed) for r in ud.dedup_units(docs_of(rows)).collect()}
    want = brute(rows, ud.LINE_WORDS, ud.BLOCK_WORDS)
    text = dict(rows)
    for d, spans in want.items():
        assert got[d][0] == spans
        kept = "".join(text[d][a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text[d])]))
        assert got[d][1:] == (kept, sum(b - a for a, b in spans))
    assert want[0] == [] and all(want[i] for i in range(1, 12)) and want[22] == []
    sentence = passage.split(". ")[3]
    assert sentence in got[0][1] and sentence not in got[5][1]


def test_settling_in_tasks_changes_nothing(docs_of, words):
    line, passage = words(14), ". ".join(words(8).capitalize() for _ in range(8)) + "."
    rows = [(i, f"{line}\n{words(30)} {passage}\n{words(40)}.\n{line if i % 2 else words(12)}") for i in range(40)]
    def spans(held):
        return {(r.doc_id, tuple(map(tuple, r.removed))) for r in ud.repeated_spans(keyed(docs_of(rows)), held_units=held).collect()}
    want = brute(rows, ud.LINE_WORDS, ud.BLOCK_WORDS)
    for held in (1, 50, ud.HELD_UNITS):
        assert spans(held) == {(d, tuple(v)) for d, v in want.items() if v}


def test_passage_inside_one_sentence(docs_of, words):
    passage = words(70)
    rows = [(i, f"É {words(30)} {passage if i % 2 else passage.upper()} {words(25)}") for i in range(8)]
    got = {r.doc_id: r.text for r in ud.dedup_units(docs_of(rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 8):
        left = got[i].lower().split()
        assert left[:31] == rows[i][1].lower().split()[:31] and left[-25:] == rows[i][1].lower().split()[-25:]
        assert len(left) - 56 <= 30


def test_every_shared_window_shares_a_run(words):
    for _ in range(200):
        passage = words(50)
        a, b = ({d for *_, d in ud.word_runs(f"{words(40)} {passage} {words(40)}")} for _ in range(2))
        assert a & b


def test_odd_rows(docs_of, words):
    text = words(40)
    rows = [(2, text), (2, text), (None, text), (3, None), (4, ""), (5, text.upper()), (6, "x " * 60000)]
    got = [((r.doc_id if r.doc_id is not None else -1), len(r.text), r.n_removed) for r in ud.dedup_units(docs_of(rows)).collect()]
    assert sorted(got) == sorted([(-1, len(text), 0), (2, 0, len(text)), (2, 0, len(text)), (3, 0, 0), (4, 0, 0), (5, 0, len(text)), (6, 120000, 0)])


def test_empty_table(docs_of):
    assert ud.dedup_units(docs_of([])).count() == 0
