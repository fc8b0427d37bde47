"""Block filters by time and speaker: bounds per ordinal range and block bitmaps per speaker, combined before any term is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import chat
from citeloom.functions import text as tx
from citeloom.operators import blocks as bl
from citeloom.session import at_most, broadcast_if, materialise

#: A bitmap covers 32,768 blocks in 4 kB.
MOST_BITMAPS = 8_192


@dataclass
class FilterIndex:
    """``bounds`` (ordinal_range, first_created, last_created, undated): one row per range. ``speakers`` (speaker, ordinal_range, bucket,
    bits): the blocks of each speaker; the null speaker stands for all blocks that have metadata."""

    bounds: DataFrame
    speakers: DataFrame


def filter_index(blocks: DataFrame) -> FilterIndex:
    m = F.col("chat_metadata")
    rows = blocks.filter(m.isNotNull())
    bounds = rows.groupBy("ordinal_range").agg(F.min(m["created_at"]).alias("first_created"), F.max(m["created_at"]).alias("last_created"),
                                               F.count_if(m["created_at"].isNull()).alias("undated"))
    bits = rows.select(F.explode(F.array(m["speaker"], F.lit(None).cast("string"))).alias("speaker"), "ordinal_range", "block_ordinal")
    return FilterIndex(materialise(bounds, "bounds"), materialise(bitmaps(bits, "speaker", "ordinal_range"), "speakers"))


def bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """Block ordinals as bitmaps: (keys…, bucket, bits)."""
    return rows.groupBy(*keys, F.bitmap_bucket_number("block_ordinal").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("block_ordinal")).alias("bits"))


def bit_is_set(bits: Column, ordinal: Column) -> Column:
    at = F.bitmap_bit_position(ordinal)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def allowed_blocks(index: FilterIndex, blocks: DataFrame, *, created_after=None, created_before=None, speaker: str | None = None) -> DataFrame:
    """(bucket, bits) of the blocks that pass; nothing else of them is kept.

    Ranges outside the times are not read at all, ranges inside them are answered by the bitmaps, and only in ranges that a
    bound cuts are blocks looked at one by one. Blocks without metadata never pass.
    """
    low, high = chat.filter_timestamp(F.lit(created_after)), chat.filter_timestamp(F.lit(created_before))
    wanted = F.lit(True)
    inside = F.lit(True)
    if created_after:
        wanted, inside = wanted & (F.col("last_created") >= low), inside & (F.col("first_created") >= low) & (F.col("undated") == 0)
    if created_before:
        wanted, inside = wanted & (F.col("first_created") <= high), inside & (F.col("last_created") <= high) & (F.col("undated") == 0)
    ranges = index.bounds.filter(wanted).select("ordinal_range", inside.alias("inside")).collect()  # one row per range
    whole, cut = [r[0] for r in ranges if r[1]], [r[0] for r in ranges if not r[1]]
    own = F.col("speaker").isNull() if not speaker else F.col("speaker") == tx.strip(tx.fold_plain(F.lit(speaker)))
    out = index.speakers.filter(F.col("ordinal_range").isin(whole) & own).select("bucket", "bits")
    if cut:
        part = bl.metadata_filter(blocks.filter(F.col("ordinal_range").isin(cut)), created_after=created_after, created_before=created_before, speaker=speaker)
        out = out.unionByName(bitmaps(part).select("bucket", "bits"))
    return materialise(out.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")), "allowed")


def keep_allowed(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose ``block_ordinal`` is set in the bitmaps; they are sent to the tasks only if they are few."""
    held = rows.withColumn("bucket", F.bitmap_bucket_number("block_ordinal")).join(broadcast_if(allowed, at_most(allowed, MOST_BITMAPS)), "bucket")
    return held.filter(bit_is_set(F.col("bits"), F.col("block_ordinal"))).select(*rows.columns)
