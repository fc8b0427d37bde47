"""Text files of any size, read by byte ranges instead of whole.

Spark's line reader cuts a file into ranges and finds the next line border on its own. Here lines get their numbers from one count
per range, a block's first line from the last blank line before it (carried over ranges the same way), and blocks of at most
``max_lines`` lines are put together by their first line. No file, and no paragraph however long, has to fit a row or a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.operators import blocks as bl
from citeloom.session import materialise
from citeloom.sources.corpus import path_of, unread_files, wanted_paths


def numbered_lines(spark: SparkSession, path: str, suffixes: Iterable[str] | None = fv.TEXT_SUFFIXES, *, unread: str = "fail") -> DataFrame:
    """(source_path, range_start, line_no, line) of all text files below ``path``, as written table; lines as Python's
    splitlines gives them, from 1."""
    if unread == "fail" and (lost := unread_files(spark, path, suffixes)):
        raise ValueError(f"rename these files, Spark's readers skip them: {', '.join(lost)}")
    raw = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
           .select(path_of(F.col("_metadata.file_path")).alias("source_path"), F.col("_metadata.file_block_start").alias("range_start"), "value"))
    # one carriage return belongs to the line feed that the reader took; other breaks inside are breaks of their own
    lines = F.explode(F.split(F.regexp_replace("value", r"\r\z", ""), tx.LINE_BREAK, -1))
    rows = wanted_paths(raw, suffixes).select("source_path", "range_start", lines.alias("line")).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows, "lines")
    spans = rows.groupBy("source_path", "range_start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("source_path").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).drop("first", "n")
    return rows.join(spans, ["source_path", "range_start"]).select("source_path", "range_start", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def line_blocks(spark: SparkSession, path: str, suffixes: Iterable[str] | None = fv.TEXT_SUFFIXES, *, max_lines: int = fv.MAX_BLOCK_LINES,
                id_prefix: str = "CIT", unread: str = "fail") -> DataFrame:
    """Blocks of text files with the columns, numbers and ids that ``split_documents`` gives for whole files. A file of white space
    alone gives no block; a byte order mark at a file's start is not part of its text."""
    lines = numbered_lines(spark, path, suffixes, unread=unread).withColumn("blank", tx.is_blank(F.col("line")))
    ends = lines.filter("blank").groupBy("source_path", "range_start").agg(F.max("line_no").alias("last"))
    spans = lines.select("source_path", "range_start").distinct().join(ends, ["source_path", "range_start"], "left")
    earlier = W.partitionBy("source_path").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("carried", F.coalesce(F.max("last").over(earlier), F.lit(0))).drop("last")
    inside = W.partitionBy("source_path", "range_start").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = (lines.withColumn("own", F.max(F.when(F.col("blank"), F.col("line_no"))).over(inside)).filter(~F.col("blank"))
            .join(spans, ["source_path", "range_start"]).withColumn("start", F.coalesce("own", "carried") + 1))
    begin = F.col("start") + F.floor((F.col("line_no") - F.col("start")) / max_lines) * max_lines
    blocks = rows.groupBy("source_path", begin.alias("line_start")).agg(
        F.max("line_no").alias("line_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    numbered = bl.number_in_groups(materialise(blocks, "blocks"), ["source_path"], [F.asc("line_start")], "block_index")
    return bl.with_ids(numbered.select(F.split("source_path", "/").alias("source_key"), "source_path", F.col("block_index").cast("int").alias("block_index"),
                                       F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "text"), id_prefix)
