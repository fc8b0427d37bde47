"""Mixing of sources to target word counts by Efraimidis-Spirakis keys. Built-in functions only.

The text is read once, for its size. Prefix sums run over small key ranges of a source, so one source with a third
of all documents is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeloom.session import materialise

WEIGHTS = (5, 2, 1)
ROWS_PER_RANGE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Target words of each source: ``share`` of all words by weight (given in turn to the sources in code-point order, null
    last), at most ``most`` times its own words; what is above goes to the others by weight.

    That is water filling: sources sorted by cap per weight are full up to the level at which the rest share evenly. One
    row per source passes through the window, not one per document. ``sizes``: source, size.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int")))
    ratio = most * F.col("source_size") / F.col("weight")
    line = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    full = F.coalesce(F.sum("source_size").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum("weight").over(line.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = own.withColumn("_ratio", ratio).withColumn("_level", (share * F.sum("source_size").over(whole) - full) / rest)
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).over(whole)["_level"]
    target = F.least(most * F.col("source_size").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return out.withColumn("target", target).select("source", "weight", "source_size", "source_rows", "target")


def unit_draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by key and seed: 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def mix(rows: DataFrame, *, seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """How often each row is taken. ``rows``: any columns with doc_id, source, size (words) and quality (weight over 0).

    A source's target is served by complete epochs first. The rest of it is a draw without replacement: rows sorted by
    ``-ln(draw) / quality`` and taken while at least half of the row lies inside the rest, so a source's words miss its
    target by half a document at most. Adds source_size, target, epochs, copies and taken. The order depends on seed,
    doc_id and columns of the row alone; equal rows are interchangeable. Null sources are a source, empty rows take none.
    """
    targets = source_targets(rows, weights=weights, share=share, most=most)
    keyed = rows.withColumn("_key", -F.log(unit_draw(F.col("doc_id"), seed)) / F.col("quality"))
    keyed = keyed.join(targets, keyed["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ranges = F.ceil(F.col("source_rows") / ROWS_PER_RANGE)
    keyed = keyed.withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * ranges), ranges - 1))
    sums = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("source").orderBy("_range")) - F.col("_sum")
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), before.alias("_before"))
    out = keyed.join(sums, keyed["source"].eqNullSafe(sums["_s"]) & (keyed["_range"] == sums["_r"]))
    inside = W.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("_before") + F.sum("size").over(inside) - F.col("size")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("epochs", rate.cast("int")).withColumn(
        "_drawn", (start + F.col("size") / 2 < F.col("target") - F.col("epochs") * F.col("source_size")) & (F.col("epochs") < most))
    out = out.withColumn("copies", F.col("epochs") + F.col("_drawn").cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_key", "_range", "_s", "_r", "_before", "_drawn", "source_rows", "weight")


def sized(docs: DataFrame, labels: DataFrame | None, *carry: Column) -> DataFrame:
    """Narrow rows for :func:`mix`: doc_id, source, size and quality, here 2 for rows labelled 1, a half for rows
    labelled 0 and 1 for the rest; written to the shared folder so that the text is read once."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry)
    if labels is None:
        return materialise(rows.withColumn("quality", F.lit(1.0)), "sizes")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_mark"))
    rows = rows.join(marks, "doc_id", "left")
    quality = F.when(F.col("_mark") == 1, 2.0).when(F.col("_mark") == 0, 0.5).otherwise(1.0)
    return materialise(rows.withColumn("quality", quality).drop("_mark"), "sizes")


def take(docs: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows it takes no time are gone.

    Rows are told apart by a digest of their columns; equal rows share what is taken of them evenly.
    """
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in docs.columns)))
    chosen = mix(sized(docs, labels, digest.alias("_row")), **options)
    totals = chosen.groupBy("_row").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    joined = docs.withColumn("_cl_row", digest).join(totals.toDF("_cl_row", "_cl_copies", "_cl_rows"), "_cl_row")
    nth = F.row_number().over(W.partitionBy("_cl_row").orderBy("_cl_rows"))
    own = F.floor(F.col("_cl_copies") / F.col("_cl_rows")) + (nth <= F.col("_cl_copies") % F.col("_cl_rows")).cast("int")
    return joined.withColumn("_cl_own", own.cast("int")).filter("_cl_own > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("_cl_own"))).alias("_cl_copy")).drop("_cl_copy")
