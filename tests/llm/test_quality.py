"""Classifier: held-out accuracy, inputs, odd rows."""

import math
import zlib

import numpy as np
import pytest

from citeloom.llm import quality as q


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(words):
    rows, marks = [], []
    for i in range(120):
        good = i % 3 > 0
        text = words(60) if good else " ".join(w.upper() + "!!" for w in words(60).split())
        rows.append((i, text))
        marks.append((i, int(good), 0))
    return rows, marks


def test_held_out_accuracy_and_flags(spark, docs_of, words):
    rows, marks = corpus(words)
    out = q.classify(docs_of(rows), labels_of(spark, marks)).collect()
    right = {i: y for i, y, _ in marks}
    assert len(out) == 120 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(int(r.score >= 0.5) == right[r.doc_id] for r in held) >= 0.95 * len(held)


def test_score_depends_on_the_text_alone(spark, docs_of, words):
    rows, marks = corpus(words)
    model = q.fit(docs_of(rows), labels_of(spark, marks))
    text = words(50)
    a = q.score(docs_of([(1, text, "x")]), model, "doc_id").first().score
    b = q.score(docs_of([(999, text, "y")]), model, "doc_id").first().score
    assert a == b


def test_score_is_the_sparse_dot_product(words):
    text = words(30).encode()
    rows, feats, size = q.hashed_ngrams([text, b"", b"one"])
    assert size.tolist() == [59, 0, 1] and (rows == 0).sum() == 59 and (rows == 2).sum() == 1


def test_learning_never_reads_held_out_rows(spark, docs_of, words):
    rows, marks = corpus(words)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in marks]
    assert (q.fit(docs_of(rows), labels_of(spark, marks)) == q.fit(docs_of(rows), labels_of(spark, turned))).all()


def test_training_state_stays_in_the_task(spark, docs_of, words, monkeypatch):
    """z and n (16 MB) went to the driver and out again with every pass."""
    rows, marks = corpus(words)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the fit sends state through the driver"))
    texts = dict(rows)
    order = spark.createDataFrame([(i,) for i in texts], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as o").orderBy("o").collect()
    order = [r.doc_id for r in order if zlib.crc32(str(r.doc_id).encode()) % 5]
    for s in (q.Settings(passes=1), q.Settings(passes=3)):
        want = q.train_ftrl([texts[i].encode() for i in order], [marks[i][1] for i in order], s)
        assert (q.fit(docs_of(rows), labels_of(spark, marks), settings=s) == want).all()


def test_odd_rows(spark, docs_of, words):
    rows, marks = corpus(words)
    odd = [(None, "text"), (500, None), (501, ""), (502, "w " * 100000), (3, rows[3][1]), (3, rows[3][1])]
    marks += [(None, 1, 0), (4, None, 0), (4, 1, 1), (9999, 0, 0)]
    out = q.classify(docs_of(rows + odd), labels_of(spark, marks)).collect()
    assert len(out) == len(rows) + len(odd)
    bias = {r.score for r in out if r.doc_id in (500, 501)}
    assert len(bias) == 1 and all(math.isfinite(r.score) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_without_labels_every_score_is_a_half(spark, docs_of):
    out = q.classify(docs_of([(1, "a b"), (2, None)]), labels_of(spark, [])).collect()
    assert [r.score for r in out] == [0.5, 0.5]
    assert q.classify(docs_of([]), labels_of(spark, [(1, 1, 0)])).count() == 0


def test_accepted_keeps_columns(spark, docs_of, words):
    rows, marks = corpus(words)
    df = docs_of(rows)
    kept = q.accepted(df, labels_of(spark, marks))
    assert kept.columns == df.columns
    want = {r.doc_id for r in q.classify(df, labels_of(spark, marks)).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_ftrl_reaches_a_separable_fit():
    w = q.train_ftrl([b"good fine"] * 20 + [b"bad ugly"] * 20, [1] * 20 + [0] * 20, q.Settings(passes=5))
    rows, feats, size = q.hashed_ngrams([b"good fine", b"bad ugly"])
    dots = np.bincount(rows, w[feats], 2) / np.sqrt(size) + w[-1]
    assert dots[0] > 0 > dots[1]


def plain_ftrl(texts, labels, s):
    """Coordinate by coordinate, from dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= s.l1 else -(zi - math.copysign(s.l1, zi)) / ((s.beta + math.sqrt(ni)) / s.alpha + s.l2)

    for _ in range(s.passes):
        for text, y in zip(texts, labels):
            _, feats, size = q.hashed_ngrams([text])
            x = {int(f): float((feats == f).sum()) / math.sqrt(max(1, size[0])) for f in set(feats)} | {1 << q.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_fit_and_score_match_plain_ftrl(spark, docs_of, words):
    rows, marks = corpus(words)
    rows, marks = rows + [(3, rows[3][1] + " zz"), (200, None), (201, "")], marks + [(200, 1, 0), (201, 0, 0)]
    model = q.fit(docs_of(rows), labels_of(spark, marks))
    least = {}
    for i, t in rows:
        least[i] = min(least.get(i, t or ""), t or "")
    label = {i: y for i, y, _ in marks}
    taught = spark.createDataFrame([(i,) for i in label], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as o").orderBy("o").collect()
    order = [r.doc_id for r in taught if zlib.crc32(str(r.doc_id).encode()) % 5]
    plain = plain_ftrl([least[i].encode() for i in order], [label[i] for i in order], q.Settings())
    assert {int(i) for i in np.flatnonzero(model)} <= plain.keys()
    assert all(abs(model[i] - v) < 1e-5 for i, v in plain.items())
    text = rows[7][1].encode()
    _, feats, size = q.hashed_ngrams([text])
    dot = sum(plain.get(int(f), 0.0) for f in feats) / math.sqrt(size[0]) + plain[1 << q.BITS]
    got = q.score(docs_of([rows[7]]), model, "doc_id").first().score
    assert abs(got - 1 / (1 + math.exp(-dot))) < 1e-4
