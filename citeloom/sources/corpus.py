"""Corpus sources: every reader gives (source_key, source_path, text)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import fixed_values as fv


def unread_files(spark: SparkSession, path: str, suffixes: Iterable[str] | None = fv.TEXT_SUFFIXES, most: int = 5) -> list[str]:
    """Some files below ``path`` that Spark's readers pass over without a word, for a part of their path starts with an
    underscore, although they are no hidden files. Names alone are listed, by the file system the path belongs to."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found, base = fs.listFiles(root, True), [], len(root.toUri().getPath().rstrip("/"))
    while files.hasNext() and len(found) < most:
        name = files.next().getPath().toUri().getPath()
        parts = [p for p in name[base:].split("/") if p]
        wanted = suffixes is None or name.lower().endswith(tuple(f".{s.lstrip('.')}" for s in suffixes))
        if wanted and not any(p.startswith(".") for p in parts) and any(p.startswith("_") and "=" not in p for p in parts):
            found.append(name)
    return found


def scan_text(spark: SparkSession, path: str, suffixes: Iterable[str] | None = fv.TEXT_SUFFIXES, *, unread: str = "fail") -> DataFrame:
    """Text files below a folder, hidden parts skipped. Files sort by path part, not by the
    plain path string; ``suffixes=None`` takes every file. Spark's readers cannot open names that start with an underscore:
    such files are an error, or left out with ``unread="skip"``."""
    if unread == "fail" and (lost := unread_files(spark, path, suffixes)):
        raise ValueError(f"rename these files, Spark's readers skip them: {', '.join(lost)}")
    # an argument, not an option: the reader's own default would undo the option
    raw = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
           .select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text")))
    out = wanted_paths(raw.withColumn("source_path", path_of(F.col("uri"))), suffixes)
    return out.select(F.split("source_path", "/").alias("source_key"), "source_path", "text")


def path_of(uri: Column) -> Column:
    """A local path from a file URI; other URIs stay."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def wanted_paths(rows: DataFrame, suffixes: Iterable[str] | None) -> DataFrame:
    """Rows of files with a wanted suffix and no hidden part."""
    if suffixes is None:
        return rows
    ends = "|".join(s.lstrip(".") for s in suffixes)
    return rows.filter(F.lower("source_path").rlike(rf"\.({ends})$")).filter(~F.col("source_path").rlike(r"/\."))


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Any-file listing with sizes; content is read only if it is selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select(F.regexp_replace("path", "^file:/*", "/").alias("source_path"),
                    F.col("length").alias("file_bytes"), "content"))


def apply_size_policy(files: DataFrame, max_bytes: int | None, policy: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """Kept files and rejected files. ``skip`` and ``fail`` both record the file and go on."""
    if policy not in ("chunk", "skip", "fail"):
        raise ValueError("policy must be chunk, skip or fail")
    over = F.lit(False) if max_bytes is None or policy == "chunk" else F.col("file_bytes") > max_bytes
    rejected = files.filter(over).select(
        "source_path", "file_bytes", F.lit(max_bytes).cast("bigint").alias("max_file_bytes"),
        F.lit(policy).alias("policy"), F.lit("file_exceeds_max_size").alias("reason"))
    return files.filter(~over), rejected


def from_table(df: DataFrame, key: Column | str, text: Column | str, prefix: str, *keep: str) -> DataFrame:
    """Any table with an id and a text column as a corpus; ids order the sources."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.col(text) if isinstance(text, str) else text
    return df.select(key.alias("source_key"), F.concat(F.lit(prefix + "/"), key.cast("string")).alias("source_path"),
                     text.alias("text"), *keep)


def from_messages(df: DataFrame, *, conversation: str, turn: str, role: str, text: str,
                  created_at: Column | None = None, prefix: str = "chat") -> DataFrame:
    """A message table as a chat corpus: one source per message, in conversation order, with
    the header fields as columns instead of header lines."""
    stamp = created_at if created_at is not None else F.lit(None).cast("timestamp")
    path = F.concat_ws("/", F.lit(prefix), F.col(conversation).cast("string"), F.col(turn).cast("string"))
    return df.select(
        F.struct(F.col(conversation).alias("c"), F.col(turn).alias("t")).alias("source_key"),
        path.alias("source_path"), F.col(text).alias("text"),
        F.struct(
            F.col(conversation).cast("string").alias("conversation_id"),
            path.alias("message_id"), F.lit(None).cast("string").alias("title"),
            F.lower(role).alias("speaker"), stamp.alias("created_at"),
            stamp.cast("string").alias("created_at_original"), F.to_date(stamp).alias("date"),
            F.date_format(stamp, "HH:mm:ss").alias("time"), F.col(turn).cast("int").alias("turn_index"),
            F.lit(fv.DEFAULT_TRUTH_SCOPE).alias("truth_scope"), F.lit(False).alias("lifetime_allowed"),
        ).alias("chat_metadata"))


def from_tokens(df: DataFrame, key: str, tokens: str, prefix: str) -> DataFrame:
    """Pre-tokenised input: an ``array<string>`` column is taken as the anchors of one block."""
    return df.select(
        F.col(key).alias("source_key"), F.concat(F.lit(prefix + "/"), F.col(key).cast("string")).alias("source_path"),
        F.array_join(tokens, " ").alias("text"), F.col(tokens).cast("array<string>").alias("tokens"))
