"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tasks import map_arrow
from citeloom.llm.words import Interned, pieces, utf8
from citeloom.session import materialise

#: Bound of the labelled sample that the model is fitted on; every document is scored.
SAMPLE_ROWS = 20_000
BITS = 20
#: ASCII punctuation, each mark a word of its own.
MARKS = tuple(bytes([c]) for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass(frozen=True)
class Settings:
    """Learning rate, smoothing and penalties of FTRL-proximal, and the passes over the sample."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    passes: int = 2


def feature_words(text: bytes) -> list[bytes]:
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, b" " + mark + b" ")
    return text.split()


def hashed_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of every word and word pair of the texts, and the number of features of each row. A pair of equal
    words is the one feature 0 whatever the word, so that repetition is learnt as such."""
    it = Interned(map(feature_words, texts))
    h, rows = it.hashes(), it.rows
    one = (h >> np.uint64(64 - BITS)).astype(np.int64)
    same = rows[1:] == rows[:-1]
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    two = np.where(it.ids[1:] == it.ids[:-1], 0, (pair >> np.uint64(64 - BITS)).astype(np.int64))[same]
    return np.concatenate([rows, rows[1:][same]]), np.concatenate([one, two]), 2 * it.lens - (it.lens > 0)


def packed_row(text: bytes) -> bytes:
    """Number of all features of a text, steps between its distinct features (ascending) and their counts, compressed."""
    _, feats, size = hashed_ngrams([text])
    at, count = np.unique(feats, return_counts=True)
    return zstandard.compress(np.concatenate([size, np.diff(at, prepend=0), count]).astype("<u4").tobytes())


def unpacked_row(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text, ascending, and their values: counts over the root of the number of all features."""
    held = np.frombuffer(zstandard.decompress(data), "<u4")
    steps, counts = np.split(held[1:], 2)
    return np.cumsum(steps, dtype=np.int64), counts / np.sqrt(max(1, int(held[0])))


def fresh_state() -> tuple[np.ndarray, np.ndarray]:
    """FTRL's z and n of each feature; the last entry is the bias."""
    return np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)


def ftrl_weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    pull = np.sign(z) * s.l1 - z
    return np.where(np.abs(z) <= s.l1, 0.0, pull / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows: Iterable[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> None:
    """One pass of FTRL-proximal over (features, values, label) in the order given; z and n change in place."""
    for at, x, y in rows:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
        zi, ni = z[at], n[at]
        w = ftrl_weights(zi, ni, s)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        more = ni + g * g
        z[at], n[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / s.alpha * w, more


def train_ftrl(texts: list[bytes], labels: list[int], s: Settings) -> np.ndarray:
    """Weights after all passes over texts at hand; the last entry is the bias."""
    z, n = fresh_state()
    for _ in range(s.passes):
        ftrl_pass(z, n, ((*unpacked_row(packed_row(t)), y) for t, y in zip(texts, labels, strict=True)), s)
    return ftrl_weights(z, n, s).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, settings: Settings = Settings()) -> np.ndarray:
    """Model of the quality labels, fitted on the ``sample_rows`` labelled documents outside the held-out fifth whose hashed
    doc_id is smallest, in that order. Repeated labels count as the highest, of repeated doc_ids the smallest text is taken.
    Without rows or passes all weights are 0, so every score is a half.

    Features are hashed where the texts are; one task reads the compressed sparse rows as one sorted stream, pass after pass, and
    holds z, n and one batch of rows. Only the weights leave it, compressed, so the driver sees neither z nor n.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    ids = docs.select("doc_id").filter(~held_out()).join(marks, "doc_id").distinct()
    chosen = materialise(ids.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample_rows), "sample")
    if not settings.passes or chosen.isEmpty():
        return np.zeros((1 << BITS) + 1, np.float32)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("_order", "doc_id").agg(  # sample_rows ids at most
        F.min("text").alias("text"), F.first("label").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            found = pa.array(map(packed_row, utf8(batch.column("text"))), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "row"])

    names = ["_order", "doc_id", "label"]
    sparse = materialise(map_arrow(rows, features, rows.select(*names).schema.add("row", "binary")), "features")
    passes = F.explode(F.sequence(F.lit(1), F.lit(settings.passes)))
    stream = sparse.withColumn("_pass", passes).repartition(1).sortWithinPartitions("_pass", "_order", "doc_id").select("label", "row")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = fresh_state()
        for batch in batches:
            ftrl_pass(z, n, ((*unpacked_row(row.as_py()), y.as_py()) for y, row in zip(*batch.columns, strict=True)), settings)
        weights = ftrl_weights(z, n, settings).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(weights.tobytes())], pa.binary())], names=["weights"])

    return np.frombuffer(zstandard.decompress(map_arrow(stream, train, "weights binary").first()["weights"]), "<f4")


def score(docs: DataFrame, model: np.ndarray, *carry: str, into: str = "score") -> DataFrame:
    """``carry`` columns and ``into`` (0 to 1) of every whole text: the sigmoid of one sparse dot product. The text alone
    is an input; null and empty texts get the sigmoid of the bias."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in pieces(batches, "text", 1 << 20):
            rows, feats, size = hashed_ngrams(utf8(batch.column("text")))
            dot = np.bincount(rows, w[feats], batch.num_rows) / np.sqrt(np.maximum(size, 1)) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], names=[*names, into])

    names = list(dict.fromkeys(carry))
    schema = docs.select(*names).schema.add(into, "double")
    return map_arrow(docs.select(*dict.fromkeys([*names, "text"])), run, schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, *, accept_from: float = 0.3, **fitting) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``accept_from``) of every row; repeated rows stay repeated, a null
    doc_id is scored and never trained on, other columns are ignored."""
    model = fit(docs, labels, **fitting)
    return score(docs, model, "doc_id").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept_from).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, accept_from: float = 0.3, **fitting) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged."""
    model = fit(docs, labels, **fitting)
    return score(docs, model, *docs.columns, into="_cl_score").filter(F.col("_cl_score") >= accept_from).select(*docs.columns)
