"""Inverted lists and neighbour lists: tables in key order, cut into parts of alike size.

A list table is range-partitioned and sorted by its key and what follows it, so the list of a hot key is cut over as many
parts as it fills. ``fences`` keeps the first and last key of every part; from them the keys of a question name the parts
to read, before anything is read. Inside a part the order lets Parquet skip row groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialise

PART_ROWS = 1 << 19
MOST_PARTS = 16_384
#: Up to so many keys are written into the plan, which reach the scan; more are left to the join that follows.
MOST_LITERALS = 300


@dataclass
class KeyedFiles:
    """``table`` with its partition column ``part``; ``fences`` (part, first, last) holds one row per part."""

    table: DataFrame
    key: str
    fences: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.table.drop("part")

    @cached_property
    def _known(self) -> tuple[list[int], list[str], list[str]]:
        found = sorted((r["part"], r["first"], r["last"]) for r in self.fences.collect())  # MOST_PARTS rows at most
        return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    def parts_of(self, keys: Iterable[str]) -> list[int]:
        """Parts that may hold one of the keys. Strings compare by code point here and by their UTF-8 bytes in Spark, which
        is the same order."""
        parts, first, last = self._known
        out: set[int] = set()
        for k in keys:
            out.update(parts[bisect_left(last, k):bisect_right(first, k)])
        return sorted(out)

    def pick(self, keys: Iterable[str] | None) -> DataFrame:
        """Rows of the keys (all rows for None): only their parts are listed for the scan."""
        if keys is None:
            return self.rows
        keys = sorted(set(keys))
        out = self.table.filter(F.col("part").isin(self.parts_of(keys)))
        return (out.filter(F.col(self.key).isin(keys)) if len(keys) <= MOST_LITERALS else out).drop("part")


def keyed_files(df: DataFrame, name: str, key: str, *order: Column | str) -> KeyedFiles:
    """Write ``df`` in the order of ``key`` and ``order``. It is written once as it comes, which gives its size, cheap samples for the
    range bounds and a place to start again from."""
    spark = df.sparkSession
    raw = materialise(df, f"{name}-raw")
    files = max(1, -(-raw.count() // PART_ROWS))
    parts = min(MOST_PARTS, files)
    cols = [F.col(key), *(F.col(c) if isinstance(c, str) else c for c in order)]
    part = F.floor(F.spark_partition_id() * F.lit(parts) / F.lit(files)).cast("int")
    placed = raw.repartitionByRange(files, *cols).withColumn("part", part).sortWithinPartitions("part", *cols)
    table = materialise(placed, name, "part")
    return KeyedFiles(table, key, materialise(fences_of(table, key), f"{name}-fences"))


def fences_of(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))


# -- what the lists hold -------------------------------------------------------------------

def block_postings(terms: DataFrame) -> DataFrame:
    """(anchor, block_ordinal, ordinal_range, n_terms, tf): one row per term and block; ``terms`` is bucketed by block, so the
    count inside a block needs no exchange."""
    return (terms.select("block_ordinal", "ordinal_range", "n_terms", F.explode("terms").alias("anchor"))
            .groupBy("block_ordinal", "ordinal_range", "n_terms", "anchor").agg(F.count("*").cast("int").alias("tf"))
            .select("anchor", "block_ordinal", "ordinal_range", "n_terms", "tf"))


def level(observations: Column | str) -> Column:
    """Impact level: floor of the binary logarithm."""
    return F.floor(F.log2(observations)).cast("int")


def list_heads(pairs: DataFrame, stop: Iterable[str]) -> DataFrame:
    """(anchor, level, entries): how long each level of a neighbour list is, without stop terms."""
    near = pairs.filter(~F.col("neighbor").isin(list(stop)))
    return near.groupBy("anchor", level("observations").alias("level")).agg(F.count("*").alias("entries"))
