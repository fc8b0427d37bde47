"""Incremental intake: new files or rows become count deltas, batch by batch.

Blocks never span batches (a file is read whole), so deltas add up to what one batch build
gives. The checkpoint makes a finished batch be skipped on restart, and each batch writes to
its own folder, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.operators import blocks as bl
from citeloom.operators import counts as ct
from citeloom.session import spread
from citeloom.sources.corpus import unread_files


def file_stream(spark: SparkSession, path: str, *, max_files: int | None = None, max_bytes: str | None = None,
                suffixes=fv.TEXT_SUFFIXES) -> DataFrame:
    """Whole text files as a stream, bounded per trigger. Names that start with an underscore are an error when the stream is
    set up, for Spark's readers skip them."""
    if lost := unread_files(spark, path, suffixes):
        raise ValueError(f"rename these files, Spark's readers skip them: {', '.join(lost)}")
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    ends = "|".join(s.lstrip(".") for s in suffixes)
    path_col = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    return (reader.load(path).select(path_col.alias("source_key"), path_col.alias("source_path"), F.col("value").alias("text"),
                                     F.col("_metadata.file_size").alias("file_bytes"))
            .filter(F.lower("source_path").rlike(rf"\.({ends})$")))


def table_stream(spark: SparkSession, path: str, *, key: str, text: str, prefix: str, max_files: int | None = None) -> DataFrame:
    """Rows of a growing Parquet folder as a stream of documents. ``path`` is the folder, or a
    pattern inside it such as ``folder/part-*.parquet``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    table = spark.read.parquet(path)
    one_file = any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())
    pattern, base = (name, folder) if one_file or "*" in name else ("*.parquet", path)
    schema = table.schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(base).select(
        F.col(key).alias("source_key"), F.concat(F.lit(prefix + "/"), F.col(key).cast("string")).alias("source_path"),
        F.col(text).alias("text"), F.octet_length(text).cast("bigint").alias("file_bytes"))


def write_batch(batch: DataFrame, batch_id: int, root: str, *, window: int, stop, max_doc_bytes: int | None) -> None:
    """Terms, counts, rejects and metrics of one batch; relations are counted from the stored terms when they are asked for."""
    part = f"batch_id={batch_id}"
    over = F.lit(False) if max_doc_bytes is None else F.col("file_bytes") > max_doc_bytes
    reason = (F.when(F.col("text").isNull(), F.lit("unreadable")).when(over, F.lit("over_size_limit"))
              .when(~F.is_valid_utf8("text"), F.lit("invalid_bytes")))
    spark = batch.sparkSession
    # one state per file: a bad file is set aside with its reason, and the batch goes on
    (batch.select("source_path", "file_bytes", reason.alias("reason")).withColumn("state", F.when(F.col("reason").isNull(), F.lit("taken")).otherwise(F.lit("rejected")))
     .write.mode("overwrite").parquet(f"{root}/files/{part}"))
    (spark.read.parquet(f"{root}/files/{part}").filter("state = 'rejected'").select("source_path", "file_bytes", "reason")
     .write.mode("overwrite").parquet(f"{root}/rejected/{part}"))
    rows = bl.split_documents(spread(batch.filter(reason.isNull()).drop("file_bytes")))
    # tokenised once per batch, into the batch's own folder; everything else reads it back
    (rows.select("source_path", "block_index", "block_id", "line_start", "line_end", tx.anchors(F.col("text"), stop).alias("terms"))
     .write.mode("overwrite").parquet(f"{root}/terms/{part}"))
    terms = spark.read.parquet(f"{root}/terms/{part}")
    ct.anchor_counts(terms).write.mode("overwrite").parquet(f"{root}/counts/{part}")
    counted = spark.read.parquet(f"{root}/counts/{part}")
    (terms.agg(F.count_distinct("source_path").alias("sources"), F.count("*").alias("blocks"),
               F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("anchor_observations"),
               F.coalesce(F.sum(ct.relation_total(F.size("terms"), window)), F.lit(0)).alias("relation_observations"))
     .withColumn("unique_anchors", F.lit(counted.count())).withColumn("window", F.lit(window))
     .write.mode("overwrite").parquet(f"{root}/metrics/{part}"))


def start_intake(stream: DataFrame, root: str, checkpoint: str, *, window: int = fv.RELATION_WINDOW, stop=fv.STOP_TERMS,
                 max_doc_bytes: int | None = None, available_now: bool = True) -> StreamingQuery:
    def fold(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, root, window=window, stop=stop, max_doc_bytes=max_doc_bytes)
    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def file_states(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, file_bytes, state, reason, batch_id) of every file that arrived."""
    return spark.read.parquet(f"{root}/files")


def total_counts(spark: SparkSession, root: str) -> DataFrame:
    return ct.merge_counts(spark.read.parquet(f"{root}/counts").drop("batch_id"), keys=["anchor"])


def total_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations of all batches, each by its own window: blocks never span batches, so their terms add up."""
    terms, metrics = spark.read.parquet(f"{root}/terms"), spark.read.parquet(f"{root}/metrics")
    windows = sorted(r[0] for r in metrics.select("window").distinct().collect())
    parts = [ct.relation_counts(terms.join(F.broadcast(metrics.filter(F.col("window") == w).select("batch_id")), "batch_id", "left_semi"), w) for w in windows]
    return parts[0] if len(parts) == 1 else ct.merge_counts(*parts, keys=["anchor", "neighbor", "offset"])


def run_totals(spark: SparkSession, root: str) -> DataFrame:
    """Run totals over all batches. ``unique_anchor_sum_by_batch`` adds up per-batch distincts;
    it is no distinct count of the corpus."""
    return spark.read.parquet(f"{root}/metrics").agg(
        F.count("*").alias("batches"), F.sum("sources").alias("sources"), F.sum("blocks").alias("blocks"),
        F.sum("anchor_observations").alias("anchor_observations"), F.sum("relation_observations").alias("relation_observations"),
        F.sum("unique_anchors").alias("unique_anchor_sum_by_batch"))


def batch_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every batch that was written, with its metrics, in order."""
    return spark.read.parquet(f"{root}/metrics").orderBy("batch_id")
