"""Vector forest against brute force; hidden Markov scores against sums over all state paths."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np

from citeloom.llm import hmm_lm as hm
from citeloom.llm import vector_forest as vf
from citeloom.llm.words import lower_words


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, point string")


def brute(rows, every=20, k=20):
    keep = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    keep = sorted(k for k in keep if len(k[1]) == 6)
    out = {}
    for q, v in keep:
        if q % every == 0:
            near = [(-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in keep if i != q]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


def test_forest_is_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)] + [(5, rows[5][1])]  # one hot vector, one repeated row
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (460, [float("nan")] * 6), (480, [1.0, 2.0]), (500, [float("inf")] * 6), (None, [1.0] * 6)]
    got = {}
    for r in vf.nearest(vectors(spark, rows), leaf_rows=20, visit=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        g = sorted(got[q])
        assert [x[:2] for x in g] == [x[:2] for x in want[q]] and np.allclose([x[2] for x in g], [x[2] for x in want[q]], atol=1e-12)


def test_recall_of_a_partial_search(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(2000)]
    monkeypatch.setattr(vf, "BLOCK", 64)
    got = {(r.query_id, r.vec_id) for r in vf.nearest(vectors(spark, rows), leaf_rows=40).collect()}
    want = {(q, i) for q, near in brute(rows).items() for _, i, _ in near}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_few_and_no_vectors(spark):
    assert vf.nearest(vectors(spark, [])).count() == 0
    rows = [(0, [1.0] * 6), (1, [2.0] * 6), (20, [1.0] * 6)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in vf.nearest(vectors(spark, rows)).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]


def small_model(rng, states=2):
    emit = rng.gamma(1.0, size=(hm.SYMBOLS, states))
    move = rng.gamma(1.0, size=(states, states))
    start = rng.gamma(1.0, size=states)
    return hm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(model, seq):
    """(probability, path) of every state path of a sequence."""
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield p, path


def test_forward_and_counts_are_sums_over_paths():
    rng = np.random.default_rng(8)
    model = small_model(rng)
    seqs = [np.array(rng.integers(0, 9, n), np.uint16) for n in (1, 5, 3, 7, 5)]
    start, moves, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((hm.SYMBOLS, 2))
    for s in seqs:
        total = sum(p for p, _ in paths(model, s))
        for p, path in paths(model, s):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for state, symbol in zip(path, s):
                emit[symbol, state] += p / total
    got = [sum(x) for x in zip(*(model.counts(grid, lens) for _, lens, grid in hm.batches_of(seqs)))]
    assert np.allclose(got[0], start) and np.allclose(got[1], moves) and np.allclose(got[2], emit)
    for rows, lens, grid in hm.batches_of(seqs):
        likely = np.log(model.forward(grid, lens)[1]).sum(0)
        assert np.allclose(likely, [math.log(sum(p for p, _ in paths(model, seqs[i]))) for i in rows])


def test_baum_welch_does_not_lower_the_likelihood():
    rng = np.random.default_rng(9)
    seqs = [np.array(rng.integers(0, 5, 30) + 5 * (i % 2), np.uint16) for i in range(20)]
    base = np.full(hm.SYMBOLS, 1e-9)
    base[:10] = 0.1
    model, before = small_model(rng), -np.inf
    for _ in range(6):
        likely = sum(np.log(model.forward(g, n)[1]).sum() for _, n, g in hm.batches_of(seqs))
        assert likely >= before - 1.0
        before = likely
        model = hm.Model.of(*[sum(x) for x in zip(*(model.counts(g, n) for _, n, g in hm.batches_of(seqs)))], base)


def test_base_scores_and_counts(docs_of, words, monkeypatch):
    monkeypatch.setattr(hm, "BLOCK_TOKENS", 300)
    rows = [(i, words(i % 50)) for i in range(80)] + [(None, "Lost words"), (200, None), (201, ""), (5, words(9)), (7, "rep"), (7, "rep"), (300, "unseenword " * 40000)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter()
    for d, t in rows:
        if not held(d):
            count.update(lower_words((t or "").encode()) + [None])
    total, distinct = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
    want = sorted(((d is not None, d or 0, held(d), len(w), sum(count[x] > 0 for x in w), total, round(base(w), 4)) for d, t in rows for w in [lower_words((t or "").encode()) + [None]]))
    out = hm.score_documents(docs_of(rows), passes=2).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_states_beat_single_words(docs_of):
    """Two languages of their own words: the model learns which one a text is in."""
    rng = np.random.default_rng(5)
    vocab = [[f"{c}{i}" for i in range(30)] for c in "xy"]
    rows = [(i, " ".join(rng.choice(vocab[i % 2], 40))) for i in range(120)]
    out = hm.score_documents(docs_of(rows), states=4).filter("held_out").collect()
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_no_documents(docs_of):
    assert hm.score_documents(docs_of([])).count() == 0
