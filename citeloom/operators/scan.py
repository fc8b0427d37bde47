"""What a single batch needs, straight from the terms.

Posting and neighbour lists pay when many batches ask the same index. One batch reads the terms once instead: only pairs of
its own anchors are counted, and those first against the most frequent terms (``Front``). What a pair can reach is bounded by
the rarer term's observations, so a list that is full above that bound is final; the anchors of the others are counted again
against all terms. The results are those of the lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.operators import counts as ct
from citeloom.operators import ranking
from citeloom.operators.lists import level
from citeloom.session import broadcast_if, materialise, pinned

#: The front is sent to every task.
FRONT_TERMS = 20_000


@dataclass
class Front:
    """The most frequent ``terms`` (None for all); any other term was seen at most ``below`` times."""

    terms: DataFrame | None
    below: int = 0


def front_of(counts: DataFrame, most: int | None = None) -> Front:
    """As many whole levels of the term counts, from the top, as ``most`` terms allow."""
    most = FRONT_TERMS if most is None else most
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level("observations").alias("level")).agg(F.count("*").alias("n")).collect()}  # 63 at most
    held, low = 0, None
    for at in sorted(sizes, reverse=True):
        if held + sizes[at] > most:
            break
        held, low = held + sizes[at], at
    if low is None or held == sum(sizes.values()):
        return Front(None)
    return Front(counts.filter(F.col("observations") >= 1 << low).select("anchor"), (1 << low) - 1)


def named(rows: DataFrame) -> pa.Array:
    """Distinct anchors of a short table, for the tasks."""
    return pa.array(sorted(r[0] for r in rows.select("anchor").distinct().collect() if r[0] is not None), pa.string())


def asked_relations(terms: DataFrame, anchors: DataFrame, *, small: bool, window: int = fv.RELATION_WINDOW, offsets: bool = True,
                    front: DataFrame | None = None, stop: Iterable[str] = (), first: int | None = None) -> DataFrame:
    """(anchor, neighbor[, offset], observations) of the asked anchors, against all terms or those of the front, without the
    neighbours in ``stop``. Pairs are counted by number in chunks of terms and go between tasks as short columns; with few asked
    anchors the others' pairs go before they are counted. ``first`` allows tasks to leave out entries that are not among the first so
    many of an anchor (and offset)."""
    keys = ["anchor", "neighbor", *(["offset"] if offsets else [])]
    stop = list(stop)
    if small:
        rows = ct.asked_pairs(terms, named(anchors), window, offsets=offsets, near=named(front) if front is not None else None,
                              drop=pa.array(stop, pa.string()) if stop else None, first=first)
        return rows.select(*keys, "observations")
    used = anchors.select("anchor").distinct()
    rows = (ct.relation_counts(terms, window).join(used, "anchor", "left_semi") if offsets
            else ct.asked_totals(terms, used, window, first=None if stop else first))
    rows = rows.filter(~F.col("neighbor").isin(stop)) if stop else rows
    return rows.select(*keys, "observations")


def posting_rows(terms: DataFrame, anchors: DataFrame, small: bool) -> DataFrame:
    """(anchor, block_ordinal, ordinal_range, n_terms, tf) of the asked anchors; ``terms`` is bucketed by block, so nothing is
    exchanged for a short batch."""
    rows = terms.select("block_ordinal", "ordinal_range", "n_terms", F.explode("terms").alias("anchor")).join(
        broadcast_if(anchors.select("anchor").distinct(), small), "anchor", "left_semi")
    return rows.groupBy("block_ordinal", "ordinal_range", "n_terms", "anchor").agg(F.count("*").cast("int").alias("tf"))


def settled(anchors: DataFrame, counts: DataFrame, rank: Callable[[DataFrame, DataFrame | None], DataFrame],
            final: Callable[[DataFrame, int], DataFrame], key: str, local: bool = False, most: int | None = None) -> DataFrame:
    """``rank(asked, front)`` ranks lists of the asked rows; ``final(ranked, below)`` names the ``key`` values whose lists no
    term outside the front can change. The others are ranked again against all terms."""
    front = front_of(counts, most)
    first = pinned(rank(anchors, front.terms), "ranked", local)
    if front.terms is None:
        return first
    sure = final(first, front.below).select(key).distinct()
    left = pinned(anchors.join(sure, key, "left_anti"), "open", local)
    if left.head() is None:
        return first
    return first.join(sure, key, "left_semi").unionByName(rank(left, None))


def batch_neighbors(terms: DataFrame, counts: DataFrame, batch, known: DataFrame, *, stop: Iterable[str] = fv.STOP_TERMS,
                    limit: int = fv.NEIGHBOR_LIMIT, window: int = fv.RELATION_WINDOW, most: int | None = None) -> DataFrame:
    """As ``ranking.relation_neighbors``: strongest neighbour terms of each question. ``known`` holds the counts of the
    batch's seeds; seeds that no block holds are left out."""
    small = batch.small
    place = F.row_number().over(W.partitionBy("question_id").orderBy("anchor"))
    ask = batch.seeds.select("question_id", "anchor").withColumn("seed_place", place).join(
        broadcast_if(known.select("anchor"), small), "anchor", "left_semi")
    ask = pinned(ask, "asked", batch.local)
    own = batch.seeds.select("question_id", F.col("anchor").alias("neighbor"))
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "first_seed", "neighbor")

    def rank(asked: DataFrame, front: DataFrame | None) -> DataFrame:
        near = asked_relations(terms, asked, small=small, window=window, offsets=False, front=front, stop=stop)
        scored = near.join(broadcast_if(asked, small), "anchor").groupBy("question_id", "neighbor").agg(
            F.sum("observations").alias("score"), F.min("seed_place").alias("first_seed"))
        return (scored.join(broadcast_if(own, small), ["question_id", "neighbor"], "left_anti").withColumn("neighbor_rank", F.row_number().over(order))
                .filter(F.col("neighbor_rank") <= limit).select("question_id", "neighbor", "score", "neighbor_rank"))

    full = lambda ranked, below: ranked.filter((F.col("neighbor_rank") == limit) & (F.col("score") > 2 * window * below))
    return settled(ask, counts, rank, full, "question_id", batch.local, most)


def strongest(terms: DataFrame, counts: DataFrame, anchors: DataFrame, limit: int, *, small: bool, window: int = fv.RELATION_WINDOW,
              most: int | None = None) -> DataFrame:
    """First ``limit`` entries of each anchor's neighbour list with their ``item_rank``; with ``most`` against a front first."""
    order = W.partitionBy("anchor").orderBy(F.desc("observations"), "neighbor")

    def rank(asked: DataFrame, front: DataFrame | None) -> DataFrame:
        rows = asked_relations(terms, asked, small=small, window=window, offsets=False, front=front, first=limit)
        return rows.withColumn("item_rank", F.row_number().over(order)).filter(F.col("item_rank") <= limit)

    used = materialise(anchors.select("anchor").distinct(), "asked")
    if not small or most is None:
        return rank(used, None)
    full = lambda ranked, below: ranked.filter((F.col("item_rank") == limit) & (F.col("observations") > 2 * window * below))
    return settled(used, counts, rank, full, "anchor", most=most)
