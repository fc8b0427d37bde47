"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched best first across all trees.

Trees are fitted on a bounded sample; every vector is then routed to one leaf of each tree. A query visits the leaves of all
trees in the order in which one shared priority queue pops them (a leaf's priority is the smallest margin on its path) and
every vector of a visited leaf is ranked by its exact inner product. Equal vectors are one vector with many ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeloom.llm.tasks import group_arrow, map_arrow, ship
from citeloom.session import materialise

#: Bound of the sample that the trees are fitted on.
SAMPLE = 16_384
TREES = 8
#: Vectors a leaf aims at, and the share of all leaves that a query visits (measured recall at 20: README).
LEAF_ROWS = 800
VISIT = 0.15
#: Vectors and queries that one task compares at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Forest:
    """Split directions (trees, nodes, dims + 1) and thresholds, nodes in heap order; ``norm`` lifts vectors to one length."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int
    norm: float

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more dimension, so that all vectors have the largest norm and inner products become angles."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf that each vector falls into."""
        up, rows = self.lift(x), np.arange(len(x))
        out = np.zeros((len(self.cuts), len(x)), np.int64)
        for t, (w, b) in enumerate(zip(self.directions, self.cuts)):
            side = up @ w.T > b
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + side[rows, at]
            out[t] = at - (self.leaves - 1)
        return out

    def visits(self, q: np.ndarray, share: float) -> np.ndarray:
        """(rows, visited): the leaves, numbered through all trees, that the shared queue pops first."""
        up = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        up /= np.linalg.norm(up, axis=1, keepdims=True)
        every = []
        for w, b in zip(self.directions, self.cuts):
            margin = up @ w.T * self.norm - b
            level = [np.full(len(q), np.inf)]
            for k in range(len(b)):
                level += [np.minimum(level[k], -margin[:, k]), np.minimum(level[k], margin[:, k])]
            every += level[len(b):]
        queue = np.stack(every, axis=1)
        return np.argsort(-queue, axis=1, kind="stable")[:, :max(1, ceil(share * queue.shape[1]))]


def fit_forest(sample: np.ndarray, depth: int, trees: int, norm: float, seed: int = 7) -> Forest:
    """Each node cuts at the median along the difference of two of its vectors."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((trees, (1 << depth) - 1, sample.shape[1] + 1)), np.zeros((trees, (1 << depth) - 1)), depth, norm)
    up = forest.lift(sample)
    for t in range(trees):
        groups = {0: up}
        for k in range((1 << depth) - 1):
            g = groups.pop(k)
            w = rng.standard_normal(up.shape[1])
            if len(g) > 1:
                i, j = rng.choice(len(g), 2, replace=False)
                if (g[i] != g[j]).any():
                    w = g[i] - g[j]
            w /= np.linalg.norm(w)
            p = g @ w
            forest.directions[t, k], forest.cuts[t, k] = w, np.median(p) if len(p) else 0.0
            groups[2 * k + 1], groups[2 * k + 2] = g[p <= forest.cuts[t, k]], g[p > forest.cuts[t, k]]
    return forest


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; the vectors have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best candidates of one query, best first, ties to the smaller id."""
    near = q @ c.T
    if len(near) > 2 * k:
        edge = np.partition(near, len(near) - k)[len(near) - k]
        keep = np.flatnonzero(near >= edge - 1e-9 * max(1.0, abs(edge)))
    else:
        keep = np.arange(len(near))
    score = (c[keep] * q).sum(1)
    order = np.lexsort((ids[keep], -score))[:k]
    return ids[keep][order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) rows that take part: not null, not zero, all components finite, and as long as most are."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return v.filter(F.size("embedding") == (size["n"] if size else 0)).distinct()


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, trees: int = TREES, leaf_rows: int = LEAF_ROWS, visit: float = VISIT,
            sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found for each row whose vec_id is divisible by ``every``, among all other rows: query_id, rank,
    vec_id, score (inner product in doubles), nearest first, ties to the smaller vec_id.

    Rows whose id or vector is null, whose vector is zero, holds null or non-finite components, or differs in length from
    most, take no part. Repeated rows are one row; rows that share a vector keep all their ids; with fewer candidates than
    ``k`` all found are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialise(usable(vectors), "vectors")
    # k + 1 smallest ids of a vector: with its own id out, no larger id can be among its k nearest
    nth = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    points = materialise(rows.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).groupBy("embedding").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "embedding"), "points")
    n = points.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    norm = points.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    drawn = points.orderBy(F.xxhash64("point"), "point").limit(sample).select("embedding").collect()
    fitted = np.array([r[0] for r in drawn])
    depth = max(0, min(int(log2(max(1.0, n / leaf_rows))), int(log2(max(1, len(fitted) // 16)))))
    forest = fit_forest(fitted, depth, trees if depth else 1, norm)
    held = spark.sparkContext.broadcast(forest)  # trees * leaves * (dims + 1) doubles, bounded by the sample
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").join(
        points.select("embedding", "point"), "embedding").select("query_id", "point")
    queries = materialise(queries, "queries")
    asked = points.join(queries.select("point").distinct(), "point", "left_semi").select("point", "embedding")
    blocks = ceil(n / forest.leaves / BLOCK)
    query_blocks = ceil(asked.count() * visit / BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            leaf = f.leaf_of(matrix(batch.column("embedding")))
            block = batch.column("point").to_numpy() % blocks
            for t in range(len(leaf)):
                for qb in range(query_blocks):
                    key = ((t * f.leaves + leaf[t]) * blocks + block) * query_blocks + qb
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("point"), batch.column("embedding")], names=["key", "point", "embedding"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                leaf = f.visits(matrix(batch.column("embedding")), visit)
                point = batch.column("point").to_numpy()
                for b in range(blocks):
                    row = np.repeat(np.arange(len(point)), leaf.shape[1])
                    key = (leaf.reshape(-1) * blocks + b) * query_blocks + point[row] % query_blocks
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key), pa.array(point[row]), batch.column("embedding").take(pa.array(row))], names=["key", "point", "embedding"])

    def compare(left, right):
        ids, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            c, cid = matrix(left.column("embedding")), left.column("point").to_numpy()
            for point, q in zip(right.column("point").to_pylist(), matrix(right.column("embedding"))):
                i, s = best(q, c, cid, k + 1)
                ids.append(point)
                found.append(i)
                scores.append(s)
        return pa.table({"query": pa.array(ids, pa.int64()), "points": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    def merge(table):
        found = table.column("points").combine_chunks().flatten().to_numpy()
        score = table.column("scores").combine_chunks().flatten().to_numpy()
        _, first = np.unique(found, return_index=True)
        found, score = found[first], score[first]
        order = np.lexsort((found, -score))[:k + 1]
        return pa.table({"query": pa.array(np.full(len(order), table.column("query")[0].as_py())), "point": pa.array(found[order]), "score": pa.array(score[order])})

    schema = points.select(F.col("point").alias("key"), "point", "embedding").schema
    candidates, visits = map_arrow(points.select("point", "embedding"), place, schema), map_arrow(asked, ask, schema)
    some = candidates.groupBy("key").cogroup(visits.groupBy("key")).applyInArrow(compare, "query long, points array<long>, scores array<double>")
    top = group_arrow(some.groupBy("query"), merge, "query long, point long, score double")
    hits = top.join(points.select("point", "ids"), "point").select(F.col("query").alias("point"), "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.join(queries, "point").filter("vec_id != query_id").withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
