"""Components and kept rows against brute force over all pairs."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from citeloom.llm import jaccard_join as jj
from citeloom.llm.words import lower_words


def shingles(text, n):
    w = lower_words((text or "").encode())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(text, step, word):
    w = text.split()
    return " ".join(word if i % step == step - 1 else x for i, x in enumerate(w))


@pytest.fixture
def rows(words):
    base, chain = words(200), words(120)
    out = [(i, edited(base, 200 - i, f"e{i}")) for i in range(1, 12)]  # a group of near copies around one text
    text = chain
    for i in range(20, 26):  # a chain whose ends are not alike
        out.append((i, text))
        w = text.split()
        w[(i - 20) * 15] = f"c{i}"
        text = " ".join(w)
    shared = words(60)
    out += [(40 + i, f"{words(40)} {shared} {words(40)}") for i in range(8)]  # one passage, otherwise different
    out += [(60, "one"), (61, "ONE"), (62, "one two"), (63, ""), (64, None), (65, " \t\n"), (66, "two one")]
    out += [(70, base), (71, base), (72, base.upper())]
    out += [(80 + i, words(30)) for i in range(10)]
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_components_match_all_pairs(docs_of, rows, n, percent):
    got = jj.near_duplicates(docs_of(rows), n=n, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, n, percent)


def test_pivot_rounds_and_open_pairs_agree(docs_of, rows, monkeypatch):
    monkeypatch.setattr(jj, "ROUNDS", 0)
    got = jj.near_duplicates(docs_of(rows), n=3, percent=90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 3, 90)


def test_shuffled_fetch_of_sets(docs_of, rows, monkeypatch):
    monkeypatch.setattr(jj, "BROADCAST_IDS", 0)
    got = jj.near_duplicates(docs_of(rows[:14]), n=3, percent=90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows[:14], 3, 90)


def test_large_group_needs_few_comparisons(docs_of, words):
    base = words(150)
    rows = [(i, edited(base, 140 - i % 40, f"w{i}")) for i in range(120)]
    facts = jj.set_facts(jj.keyed(docs_of(rows)), 3)
    assert facts.filter("chunk is null").count() == 120
    got = jj.near_duplicates(docs_of(rows), n=3, percent=90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 3, 90)


def test_unlike_copies_are_not_met_list_by_list(docs_of, words, monkeypatch):
    """Copies with 16 of 302 shingles of their own: no two link, but their bitmaps left every pair open in every list that some
    other text, here one of two halves, holds early."""
    bases = [words(304).split() for _ in "ab"]
    rows = [(100 * j + i, " ".join(f"v{j}x{i}x{k}" if (k - 4) % 60 == 2 * i or k == 2 * i + 65 else w for k, w in enumerate(base)))
            for j, base in enumerate(bases) for i in range(27)]
    rows.append((300, " ".join(bases[0][:152] + bases[1][152:])))
    met, plain = [], jj.materialise

    def seen(df, name, *by):
        out = plain(df, name, *by)
        if name == "met":
            met.append(out.count())
        return out
    monkeypatch.setattr(jj, "materialise", seen)
    got = jj.near_duplicates(docs_of(rows), n=3, percent=90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 3, 90)
    assert sum(met) <= 54


def test_of_equal_lists_the_first_token_stays(spark):
    rows = [(7, 5, 9, 3), (8, 5, 9, 2), (7, 5, 4, 5), (8, 5, 4, 6), (7, 5, 6, 0)]  # tokens 9 and 4 hold the same sets
    entries = spark.createDataFrame(rows, "sid long, n int, token long, pos int")
    assert sorted((r.sid, r.token, r.pos) for r in jj._one_list_each(entries).collect()) == [(7, 9, 3), (8, 9, 2)]


def test_empty_table(docs_of):
    assert jj.near_duplicates(docs_of([]), n=3, percent=90).count() == 0
    assert jj.first_of_groups(docs_of([]), n=3, percent=90).count() == 0


def test_first_of_groups_keeps_one_row_each(docs_of, words):
    a, b = words(60), words(60)
    rows = [(3, a), (3, a), (1, a), (5, b), (None, b), (7, ""), (7, ""), (8, None), (1, words(50)), (9, words(50))]
    df = docs_of(rows)
    got = jj.first_of_groups(df, n=5, percent=80)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in got.collect())
    want = sorted([(1, a), (-1, b), (7, ""), (7, ""), (8, ""), (1, rows[8][1]), (9, rows[9][1])])
    assert kept == want


def test_equal_prints_in_a_head_keep_the_bound(spark):
    import numpy as np

    tokens = np.array([1, 2, 1 + 2**32, 3, 2 + 2**33], np.uint64)
    head = jj.prints(tokens).tolist()
    row = spark.createDataFrame([(5, head, 5, head)], "a int, ah array<int>, b int, bh array<int>")
    assert row.select(jj.at_most_common(row.a, row.ah, row.b, row.bh)).first()[0] == 5
    assert jj.prints(tokens[:2]).tolist() == [1, 2] and not len(jj.prints(tokens[:0]))


def test_bitmap_bound_is_never_under_the_bound_of_heads(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 3, 40, 400) * 5:
        base = rng.permutation(3 * size).astype(np.uint64) * np.uint64(2654435761)
        a, b = (jj.prints(base[np.sort(rng.choice(2 * size, size, replace=False))]) for _ in "ab")
        rows.append((size + 7, a.tolist(), jj.print_bits(a), size + 9, b.tolist(), jj.print_bits(b)))
    row = spark.createDataFrame(rows, "a int, ah array<int>, ab array<long>, b int, bh array<int>, bb array<long>")
    words = [[F.col(c)[i] for i in range(jj.BITMAP_WORDS)] for c in ("ab", "bb")]
    out = row.select(
        jj.at_most_common(row.a, row.ah, row.b, row.bh).alias("heads"), F.least("a", "b").alias("most"),
        jj.at_most_common_bits(row.a, F.size("ah"), words[0], row.b, F.size("bh"), words[1]).alias("bits")).collect()
    assert all(r.heads <= r.bits <= r.most for r in out) and any(r.bits < r.most for r in out)
