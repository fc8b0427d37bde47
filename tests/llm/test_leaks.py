"""Edit matching against plain dynamic programming over all stretches."""

import random

from citeloom.llm import leaks as lk


def distance(pattern, words):
    before = [0] * (len(words) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, w in enumerate(words, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != w)))
        before = now
    return min(before)


def test_myers_is_the_edit_distance():
    rnd = random.Random(2)
    for _ in range(500):
        p = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 70))]
        w = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(0, 90))]
        assert lk.myers(lk.pattern(p), len(p), w)[0] == distance(p, w)


def test_cut_covers_the_item():
    for n in range(1, 80):
        spans = lk.cut(n, 0.2)
        assert len(spans) == min(n, int(0.2 * n) + 1)
        assert [i for a, m in spans for i in range(a, a + m)] == list(range(n))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_hits_match_brute_force(spark, docs_of, words):
    rnd = random.Random(9)
    bench = [(i, words(rnd.randrange(8, 40))) for i in range(12)]
    rows = []
    for i in range(60):
        text = words(rnd.randrange(0, 60)).split()
        if i % 2:
            own = bench[rnd.randrange(12)][1].split()
            for _ in range(rnd.randrange(0, 9)):
                at = rnd.randrange(len(own))
                own[at:at + 1] = rnd.choice([[], ["zz"], [own[at], "yy"]]) or ["q"]
            text += own + words(rnd.randrange(0, 30)).split()
        rows.append((i, " ".join(text)))
    got = {(r.doc_id, r.item_id): r.distance for r in lk.find_leaks(docs_of(rows), items(spark, bench)).collect()}
    want = {}
    for d, text in rows:
        for i, item in bench:
            p, w = lk.plain(item).split(), lk.plain(text).split()
            if (x := distance(p, w)) <= int(0.2 * len(p)):
                want[d, i] = x
    assert got == want


def test_spans_blocks_and_odd_rows(spark, docs_of):
    item = "The quick brown fox jumps over the lazy dog near the old river bank at noon"
    long = "word " * 20000 + item + " word" * 20000
    rows = [(1, f"Éa {item.upper()}! x"), (2, None), (None, item), (3, long), (3, long), (4, ""), (5, item + "\n\n" + item), (6, "tiny item"), (7, "a tiny item here")]
    bench = items(spark, [(10, item), (11, None), (12, ""), (13, "tiny item"), (None, "another wholly different item of nine words only")])
    for block_words in (lk.BLOCK_WORDS, 1):
        got = lk.find_leaks(docs_of(rows), bench, block_words=block_words).collect()
        seen = sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id, r.distance) for r in got)
        assert seen == [(-1, 10, 0), (1, 10, 0), (3, 10, 0), (3, 10, 0), (5, 10, 0), (5, 10, 0), (6, 13, 0)]
        text = dict(r for r in rows if r[0])
        assert all(text[r.doc_id][r.start:r.end].lower() == item.lower() for r in got if r.doc_id in (1, 3, 5))
    kept = lk.without_leaks(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7]


def test_empty_tables(spark, docs_of):
    none = items(spark, [])
    assert lk.find_leaks(docs_of([(1, "a b c")]), none).count() == 0
    assert lk.without_leaks(docs_of([(1, "a b c")]), none).count() == 1
    assert lk.find_leaks(docs_of([]), items(spark, [(1, "a b c d e f g")])).count() == 0
