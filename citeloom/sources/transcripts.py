"""Staging of chat transcripts: session event lines and Markdown exports become turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import chat
from citeloom.functions import text as tx
from citeloom.operators.blocks import assign_ordinals, carry_forward
from citeloom.sources.corpus import unread_files

EVENT = ("struct<type:string,timestamp:string,payload:struct<id:string,source:string,originator:string,type:string,"
         "role:string,content:array<struct<text:string,value:string>>>>")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``.jsonl`` files, numbered in file and line order: (source_path, line_no,
    line). A file may be read in splits; the split start orders them. Names that start with an underscore are an error, for
    Spark's readers skip them."""
    if lost := unread_files(spark, path, (".jsonl",)):
        raise ValueError(f"rename these files, Spark's readers skip them: {', '.join(lost)}")
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
           .select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("source_path"),
                   F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line"))
           .withColumn("_row", F.monotonically_increasing_id()))
    return assign_ordinals(raw, ["source_path", "_start", "_row"], "line_no").drop("_start", "_row")


def event_message(event: Column) -> tuple[Column, Column]:
    """Speaker and text of one event; null speaker when the event is no user or assistant
    message. Parts give ``text`` or else ``value``."""
    p = event["payload"]
    role = F.lower(p["role"])
    is_message = (event["type"] == "response_item") & (p["type"] == "message") & role.isin("user", "assistant")
    parts = F.filter(F.transform(p["content"], lambda c: F.coalesce(c["text"], c["value"])), lambda t: t.isNotNull())
    return F.when(is_message, role), tx.strip(F.array_join(parts, "\n"))


def session_titles(index_lines: DataFrame, line: str = "line") -> DataFrame:
    """Session id → title; the last row of an id wins. Needs (line_no, line)."""
    row = F.from_json(line, "struct<id:string,thread_name:string>")
    return (index_lines.select("line_no", row.alias("r")).filter((F.col("r.id") != "") & (F.col("r.thread_name") != ""))
            .groupBy(F.col("r.id").alias("session_id")).agg(F.max_by("r.thread_name", "line_no").alias("thread_title")))


def stage_sessions(lines: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Messages of session event lines as numbered turns, in file and line order. ``lines``
    holds (source_path, line_no, line); broken lines are skipped."""
    rows = lines.withColumn("e", F.from_json("line", EVENT)).filter(F.col("e").isNotNull())
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", "")
    p = F.col("e.payload")
    meta = F.when(F.col("e.type") == "session_meta", F.struct(
        F.when(p["id"] != "", p["id"]).alias("id"),
        F.coalesce(F.when(p["source"] != "", p["source"]), F.when(p["originator"] != "", p["originator"])).alias("scope")))
    # the id and the scope are carried on their own: a later meta line may lack one of them
    rows = rows.withColumn("_meta", meta).withColumn("_id", F.col("_meta.id")).withColumn("_scope", F.col("_meta.scope"))
    rows = carry_forward(rows.drop("_meta"), "source_path", "line_no", "_id", "session_id")
    rows = carry_forward(rows, "source_path", "line_no", "_scope", "scope")
    speaker, text = event_message(F.col("e"))
    turns = rows.select("source_path", "line_no", "session_id", "scope", speaker.alias("speaker"), text.alias("text"),
                        F.coalesce(F.col("e.timestamp"), F.lit("")).alias("created_at"), stem.alias("stem"))
    turns = turns.filter(F.col("speaker").isNotNull() & (F.col("text") != ""))
    turns = assign_ordinals(turns, ["source_path", "line_no"], "turn_number", 1)
    if titles is not None:
        turns = turns.join(titles, "session_id", "left")
    else:
        turns = turns.withColumn("thread_title", F.lit(None).cast("string"))
    message_id = F.substring(F.sha1(F.concat_ws(":", "source_path", F.col("turn_number").cast("string"), "created_at",
                                                "speaker").cast("binary")), 1, 16)
    return turns.select(
        "source_path", "turn_number", F.coalesce("scope", F.lit("session")).alias("scope"),
        F.coalesce("session_id", "stem").alias("conversation_id"), message_id.alias("message_id"),
        F.coalesce("thread_title", "stem").alias("title"), "created_at", "speaker", "text")


def stage_markdown(docs: DataFrame) -> DataFrame:
    """Turns of Markdown transcripts: headings ``### n. User`` or ``### n. Assistant``, an
    optional ``Timestamp:`` line and a closing rule. ``docs`` holds (source_path, text)."""
    t = F.col("text")
    title = F.regexp_extract(t, r"(?md)^# (.*)$", 1)
    section = F.regexp_extract(t, r"(?s)(?:^|\n)[ \t]*## Source Metadata[ \t]*\n(.*?)(?=\n[ \t]*## |$)", 1)
    field = lambda name: F.regexp_replace(F.trim(F.regexp_extract(
        section, rf"(?mdi)^[ \t]*- {name}[ \t]*:(.*)$", 1)), "^`+|`+$", "")
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", "")
    pick = lambda value, other: F.when(value != "", value).otherwise(other)
    # a mark that no text holds cuts the document in front of every turn heading
    mark = "\x1e\x1e"
    cut = F.split(F.regexp_replace(t, r"(?md)^(###\s+[0-9]+\.\s+(?:User|Assistant)\s*)$", mark + "$1"), mark)
    rows = docs.select("source_path", pick(F.trim(title), stem).alias("title"),
                       pick(field("session id"), stem).alias("conversation_id"),
                       pick(field("originator"), F.lit("markdown_export")).alias("scope"),
                       F.posexplode(cut).alias("at", "piece")).filter(F.col("at") > 0)
    head = F.regexp_extract("piece", r"^###\s+[0-9]+\.\s+(User|Assistant)", 1)
    rest = F.regexp_replace("piece", r"^###\s+[0-9]+\.\s+(?:User|Assistant)[ \t]*", "")
    stamp = F.regexp_replace(F.trim(F.regexp_extract(rest, r"(?md)^[ \t]*Timestamp:(.*)$", 1)), "^`+|`+$", "")
    body = F.when(rest.rlike(r"(?md)^[ \t]*Timestamp:"), F.regexp_replace(
        rest, r"(?sd)^(?:.*?\n)??[ \t]*Timestamp:[^\n]*", "")).otherwise(rest)
    body = tx.strip(F.regexp_replace(tx.strip(body), r"(?:^|\n)[ \t]*---$", ""))
    rows = rows.select("source_path", "title", "conversation_id", "scope", "at", F.lower(head).alias("speaker"),
                       stamp.alias("created_at"), body.alias("text")).filter(F.col("text") != "")
    n = F.row_number().over(W.partitionBy("source_path").orderBy("at"))
    rows = rows.withColumn("turn_number", n.cast("bigint"))
    message_id = F.substring(F.sha1(F.concat_ws(":", "source_path", F.col("turn_number").cast("string"), "created_at",
                                                "speaker").cast("binary")), 1, 16)
    return rows.select("source_path", "turn_number", "scope", "conversation_id", message_id.alias("message_id"), "title",
                       "created_at", "speaker", "text")


def staging_receipt(turns: DataFrame) -> DataFrame:
    """One row: sessions, turns, turns by speaker, first and last time."""
    stamped = F.when(F.col("created_at") != "", F.col("created_at"))
    return turns.agg(
        F.count_distinct("source_path").alias("session_count"), F.count("*").alias("turn_count"),
        F.count_if(F.col("speaker") == "user").alias("user_turns"),
        F.count_if(F.col("speaker") == "assistant").alias("assistant_turns"),
        F.min(stamped).alias("earliest_timestamp"), F.max(stamped).alias("latest_timestamp"))


def render_turns(turns: DataFrame, export: str) -> DataFrame:
    """Turns as chat-turn text that the block reader parses back."""
    text = chat.header_text(turn=F.col("turn_number"), conversation_id=F.col("conversation_id"),
                            message_id=F.col("message_id"), title=F.col("title"), created_at=F.col("created_at"),
                            speaker=F.col("speaker"), body=F.col("text"), export=export, scope=F.col("scope"))
    return turns.select("source_path", "turn_number", text.alias("turn_text"))
