"""Chat header parsing and flexible timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx

META_TYPE = ("struct<conversation_id:string,message_id:string,title:string,speaker:string,"
             "created_at:timestamp,created_at_original:string,date:date,time:string,"
             "turn_index:int,truth_scope:string,lifetime_allowed:boolean>")


def chat_timestamp(c: Column) -> Column:
    """Timestamp from US-style date-times, ISO date-times or ISO dates; no zone means UTC.
    The session time zone must be UTC. Null where nothing fits."""
    c = tx.strip(c)
    us = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    zoned = F.regexp_replace(F.regexp_replace(c, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2"), r"Z$", "+00:00")
    return F.coalesce(
        F.when(c.rlike(us + " [AaPp][Mm]$"), F.try_to_timestamp(c, F.lit("M/d/yyyy h:m:s a"))),
        F.when(c.rlike(us + "$"), F.try_to_timestamp(c, F.lit("M/d/yyyy H:m:s"))),
        F.when(c.rlike(iso) & ~c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), zoned.try_cast("timestamp")),
        F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("timestamp")),
    )


def filter_timestamp(c: Column) -> Column:
    """As ``chat_timestamp``, but bad input is an error. A bare date means 00:00 UTC."""
    got = chat_timestamp(c)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("timestamp")).otherwise(
        F.coalesce(got, F.raise_error(F.concat(F.lit("bad date filter: "), c)).cast("timestamp")))


def _last_value(text: Column, key: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?md)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
    return tx.strip(F.try_element_at(found, F.lit(-1)))


def chat_header(text: Column) -> Column:
    """Header struct of a block, or null when the block is no header. A header needs a
    conversation id, a message id or a turn heading; the last line of a key wins."""
    v = {name: _last_value(text, key) for name, key in fv.CHAT_KEYS.items()}
    turn = F.regexp_extract(text, fv.CHAT_TURN_HEADING, 1)
    stamp = chat_timestamp(v["created_at_original"])
    meta = F.struct(
        v["conversation_id"].alias("conversation_id"),
        v["message_id"].alias("message_id"),
        v["title"].alias("title"),
        tx.fold_plain(v["speaker"]).alias("speaker"),
        stamp.alias("created_at"),
        v["created_at_original"].alias("created_at_original"),
        F.to_date(stamp).alias("date"),
        F.date_format(stamp, "HH:mm:ss").alias("time"),
        F.when(turn != "", turn.try_cast("int")).alias("turn_index"),
        v["truth_scope"].alias("truth_scope"),
        (F.lower(v["lifetime_allowed"]) == "true").alias("lifetime_allowed"),
    )
    known = (F.coalesce(v["conversation_id"], F.lit("")) != "") | (
        F.coalesce(v["message_id"], F.lit("")) != "") | (turn != "")
    return F.when(known, meta).cast(META_TYPE)


def header_text(*, turn: Column, conversation_id: Column, message_id: Column, title: Column,
                created_at: Column, speaker: Column, body: Column, export: str,
                scope: Column) -> Column:
    """Render one message as a chat turn that ``chat_header`` reads back."""
    def row(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), F.coalesce(value, F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## CHAT_TURN_"), turn.cast("string")),
        F.lit(f"CHAT_SOURCE_EXPORT: {export}"),
        row("CHAT_SOURCE_SCOPE", scope),
        row("CHAT_CONVERSATION_ID", conversation_id),
        row("CHAT_MESSAGE_ID", message_id),
        row("CHAT_TITLE", title),
        row("CHAT_CREATED_AT", created_at),
        row("CHAT_SPEAKER", speaker),
        F.lit(f"CHAT_TRUTH_SCOPE: {fv.DEFAULT_TRUTH_SCOPE}"),
        F.lit("CHAT_LIFETIME_ALLOWED: false"),
        F.lit("CHAT_TEXT:"),
        tx.strip(body),
    )
