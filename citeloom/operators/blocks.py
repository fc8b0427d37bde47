"""Blocks: splitting, ids, dense global ordinals and carry-forward of chat headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import chat
from citeloom.functions import text as tx
from citeloom.session import materialise, pieces_of

CARRY_SPAN = 4096
RANGE_BYTES = 16 << 20
MOST_RANGES = 65_536


def split_documents(docs: DataFrame, *, max_lines: int = fv.MAX_BLOCK_LINES, id_prefix: str = "CIT", headers: bool = False) -> DataFrame:
    """One row per block with its coordinates and ids; row-local, no shuffle. With ``headers`` each block also gets
    ``chat_metadata``, the last chat header of its source so far, still inside the row."""
    keep = [c for c in docs.columns if c not in ("source_key", "source_path", "text")]
    blocks = tx.text_blocks(F.col("text"), max_lines)
    if headers:
        spans = docs.select("source_key", "source_path", *keep, F.explode(header_spans(blocks)).alias("s"))
        exploded = spans.select("source_key", "source_path", *keep, F.col("s.header").alias("chat_metadata"), F.col("s.first").alias("_first"),
                                F.posexplode("s.blocks").alias("_in", "b")).withColumn("pos", F.col("_first") + F.col("_in"))
        keep = [*keep, "chat_metadata"]
    else:
        exploded = docs.select("source_key", "source_path", *keep, F.posexplode(blocks).alias("pos", "b"))
    return with_ids(exploded.select(
        "source_key", "source_path", (F.col("pos") + 1).alias("block_index"), F.col("b.line_start").alias("line_start"),
        F.col("b.line_end").alias("line_end"), F.col("b.text").alias("text"), *keep), id_prefix)


def with_ids(rows: DataFrame, id_prefix: str = "CIT") -> DataFrame:
    """Adds block_id, citation_id, marker and text_hash to numbered blocks."""
    digest = F.sha1(F.col("source_path").cast("binary"))
    out = rows.withColumn("block_id", F.concat(digest, F.lit(":"), F.col("block_index").cast("string")))
    cite = F.concat(F.lit(id_prefix + "-"), F.substring(F.sha1(F.col("block_id").cast("binary")), 1, 10))
    return (out.withColumn("citation_id", cite)
               .withColumn("marker", F.concat(F.lit("["), F.col("citation_id"), F.lit("]")))
               .withColumn("text_hash", F.sha1(F.col("text").cast("binary"))))


def assign_ordinals(df: DataFrame, order: list[str], name: str = "ordinal", start: int = 0,
                    range_name: str | None = None) -> DataFrame:
    """Dense 0-based ordinals in a global order without a single-task sort.

    A range exchange on the whole order key sorts the rows over many tasks (a hot source is
    cut between its blocks). The sorted rows are written once, one folder per range, so both
    passes below see the same rows; the second pass adds one offset per range, a table as
    short as the number of ranges, which follows the size of the input. ``range_name`` keeps the range as a column: it is the
    table's partition column, so a join on it reads only the ranges it needs.
    """
    n = pieces_of(df, RANGE_BYTES, df.sparkSession.sparkContext.defaultParallelism, MOST_RANGES)
    placed = (df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
              .sortWithinPartitions("_part", *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = materialise(placed, "ordered", "_part")
    offsets = (placed.groupBy("_part").count()
               .withColumn("_offset", F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
               .select("_part", F.coalesce("_offset", F.lit(0)).alias("_offset")))
    offsets = materialise(offsets, "offsets")
    out = placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + F.lit(start)).drop("_offset", "_at")
    return out.withColumnRenamed("_part", range_name) if range_name else out.drop("_part")


def number_in_groups(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` written with each row's place in its group, from 1, without sorting a group in one task.

    Rows are range-partitioned by group and order and written in that order, so a row's place in its range is known; the
    group's rows in earlier ranges come from a table of one count per group and range.
    """
    keys = [*(F.col(g) for g in group), *order]
    placed = (df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = materialise(placed, "in_order")
    spans = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).drop("_first", "_n")
    return placed.join(spans, [*group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def header_spans(blocks: Column) -> Column:
    """A source's block array cut before each block that opens with a chat header: (header, first, blocks). The spans share no
    block, so the work grows with the source and not with its square."""
    def cut(all_blocks: Column, heads: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(heads) - 1, F.lit(0))), lambda i: F.get(heads, i).isNotNull() | (i == 0))
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(heads)))
        return F.zip_with(at, ends, lambda a, e: F.struct(
            F.get(heads, a).alias("header"), a.alias("first"), F.slice(all_blocks, a + 1, e - a).alias("blocks")))
    return tx.let(blocks, lambda b: tx.let(F.transform(b, lambda x: chat.chat_header(x["text"])), lambda h: cut(b, h)))


def carry_forward(df: DataFrame, group: str, order: str, value: str, name: str, span: int = CARRY_SPAN) -> DataFrame:
    """Last non-null ``value`` so far within ``group``.

    Works span by span: a window inside each span of ``span`` rows, plus the last value of
    every earlier span (one row per span), so that one huge source is spread over tasks.
    """
    spanned = df.withColumn("_span", F.floor(F.col(order) / span))
    inner = W.partitionBy(group, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    tails = (spanned.filter(F.col(value).isNotNull()).groupBy(group, "_span")
             .agg(F.max_by(value, order).alias("_tail")))
    spans = spanned.select(group, "_span").distinct().join(tails, [group, "_span"], "left")
    before = W.partitionBy(group).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(group, "_span", F.last("_tail", True).over(before).alias("_carried"))
    return (spanned.withColumn("_own", F.last(value, True).over(inner))
            .join(carried, [group, "_span"], "left")
            .withColumn(name, F.coalesce("_own", "_carried"))
            .drop("_span", "_own", "_carried", value))


def metadata_filter(blocks: DataFrame, *, created_after=None, created_before=None, speaker: str | None = None) -> DataFrame:
    """Blocks inside a time range (both ends included) and of one speaker. Blocks without
    metadata drop as soon as any bound is given."""
    if not (created_after or created_before or speaker):
        return blocks
    m = F.col("chat_metadata")
    out = blocks.filter(m.isNotNull())
    if speaker:
        out = out.filter(m["speaker"] == tx.strip(tx.fold_plain(F.lit(speaker))))
    if created_after:
        out = out.filter(m["created_at"] >= chat.filter_timestamp(F.lit(created_after)))
    if created_before:
        out = out.filter(m["created_at"] <= chat.filter_timestamp(F.lit(created_before)))
    return out


def citations(blocks: DataFrame) -> DataFrame:
    return blocks.select("citation_id", "marker", "block_id", "source_path", "line_start", "line_end",
                         "text_hash").orderBy("citation_id")


def coordinates(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", "source_path", "line_start", "line_end", "citation_id").orderBy(
        "source_path", "line_start")


def chat_index(blocks: DataFrame) -> DataFrame:
    """Flat chat metadata rows by time, then ordinal."""
    return (blocks.filter(F.col("chat_metadata").isNotNull())
            .select("block_ordinal", "block_id", "citation_id", "source_path", "line_start", "line_end", "chat_metadata.*")
            .orderBy("created_at", "block_ordinal"))
