"""Substring dedup by unit hashing: digests of normalised units are grouped over all documents, the earliest keeps its place.

Units are lines, and blocks: from each sentence on, the fewest whole sentences that hold ``block_words`` words. A passage
that repeats in the middle of different lines shares no line, but shares the blocks of its own sentences. A passage inside one
sentence shares neither; for it there are runs of words whose borders come from the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeloom.llm.leaks import plain
from citeloom.llm.tasks import map_arrow
from citeloom.llm.words import pieces

LINE_WORDS = 10
BLOCK_WORDS = 20
_BASE = 0x9E3779B97F4A7C15
#: Units that a task holds at a time to settle copies among them (some 40 MB); decides no result.
HELD_UNITS = 1_000_000
UNITS = "doc_id long, row_key long, start int, end int, digest long, later boolean"


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences: up to a line break, or to marks . ! ? that white space follows."""
    out, start, n = [], 0, len(text)
    for m in re.finditer(r"[.!?]+(?=\s)|\n", text):
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    return out + [(start, n)] if start < n else out


def word_runs(text: str, block_words: int = BLOCK_WORDS) -> Iterator[tuple[int, int, int]]:
    """(start, end, digest) of runs of words: borders lie before the word of least hash (the last of equals) of every window of
    half a block, and from each border a run reaches to the first border ``block_words`` words on or later. Two texts that share
    two and a half blocks of words share a run. Runs of one word over and over are none."""
    data = plain(text)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=2) for w in data.split()), np.uint64)
    n, window = len(hashes), max(1, block_words // 2)
    if n < block_words:
        return
    least = window - 1 - np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1].argmin(1)
    borders = np.unique(least + np.arange(len(least)))
    ends = np.searchsorted(borders, borders + block_words, "left")
    first, last = borders[ends < len(borders)], borders[ends[ends < len(borders)]]
    turns = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
    varied = turns[last - 1] > turns[first]
    first, last = first[varied], last[varied]
    power, back = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
        digests = (sums[last] - sums[first]) * back[first]
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], raw != 32, [False]]).astype(np.int8)))
    chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
    yield from zip(chars[edges[::2][first]].tolist(), chars[edges[1::2][last - 1]].tolist(), digests.tolist())


def units(text: str, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> Iterator[tuple[int, int, int]]:
    """(start, end, digest) of the lines, blocks and runs of a text; digests ignore case, marks and white space."""
    yield from word_runs(text, block_words)
    at = 0
    for line in text.split("\n"):
        words = plain(line).split()
        if len(words) >= line_words:
            yield at, at + len(line), xxhash.xxh3_64_intdigest(b" ".join(words))
        at += len(line) + 1
    spans, sizes, hashes = [], [], []
    for a, b in sentences(text):
        words = plain(text[a:b]).split()
        if words:
            spans.append((a, b))
            sizes.append(len(words))
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(words), seed=1))
    if not spans:
        return
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(total, total[:-1] + block_words, "left")
    power, back = _powers(len(spans))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(hashes, np.uint64) * power)])
        first = np.arange(len(spans))
        whole = ends <= len(spans)
        first, ends = first[whole], ends[whole]
        digests = (sums[ends] - sums[first]) * back[first]
    for i, j, d in zip(first.tolist(), ends.tolist(), digests.tolist()):
        a, b = spans[i][0], spans[j - 1][1]
        a += len(text[a:b]) - len(text[a:b].lstrip())
        yield a, b, d


_table: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64; grown as needed."""
    global _table
    if len(_table[0]) < n:
        size, inverse = 2 * n, pow(_BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            _table = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse))
    return _table[0][:n], _table[1]


def unit_table(docs: DataFrame, line_words: int, block_words: int, held_units: int) -> DataFrame:
    """One row per unit of every text. Copies within ``held_units`` units of one task are settled there: all but the earliest
    are ``later`` for sure and get a digest of their own place, so that the copies of a frequent unit neither travel nor
    meet as one group."""

    def settled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        digest, doc, key, start = (table.column(c).to_numpy() for c in ("digest", "doc_id", "row_key", "start"))
        order = np.lexsort((start, key, doc, digest))
        d, place = digest[order], np.stack([doc[order], key[order], start[order].astype(np.int64)])
        fresh = np.concatenate([[True], d[1:] != d[:-1]])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = np.zeros(len(d), bool)
        later[order] = (place != place[:, first]).any(0)
        with np.errstate(over="ignore"):
            own = (key.astype(np.uint64) + start.astype(np.uint64)) * np.uint64(_BASE)
        digest = np.where(later, own.view(np.int64), digest)
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "row_key", "start", "end")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digest), pa.array(later)], names=["doc_id", "row_key", "start", "end", "digest", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        count = 0
        for batch in pieces(batches, "text"):
            found = [(i, *u) for i, t in enumerate(batch.column("text").to_pylist()) for u in units(t, line_words, block_words)]
            if not found:
                continue
            rows, start, end, digest = zip(*found)
            take = pa.array(rows)
            parts.append(pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(take), batch.column("row_key").take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                pa.array(np.array(digest, np.uint64).view(np.int64))], names=["doc_id", "row_key", "start", "end", "digest"]))
            count += len(found)
            if count >= held_units:
                yield settled(parts)
                parts, count = [], 0
        if parts:
            yield settled(parts)

    return map_arrow(docs.select("doc_id", "row_key", "text"), run, UNITS)


def merged_spans(spans) -> "F.Column":
    """Sorted spans with overlapping ones merged, as array<struct<start, end>>."""
    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), add)


def repeated_spans(docs: DataFrame, *, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS, held_units: int = HELD_UNITS) -> DataFrame:
    """(doc_id, row_key, removed): the merged spans of all units that an earlier place holds, by doc_id, then position. Units
    travel once, by digest; each partition walks its sorted rows."""
    found = unit_table(docs, line_words, block_words, held_units)
    place = F.rank().over(W.partitionBy("digest", "later").orderBy("doc_id", "row_key", "start"))
    later = found.withColumn("_place", place).filter("later or _place > 1")
    spans = later.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    return spans.select("doc_id", "row_key", merged_spans(F.col("_spans")).alias("removed"))


def dedup_units(docs: DataFrame, *, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: doc_id, text without its repeated units, removed (spans of the original text, in characters,
    end exclusive, sorted and disjoint) and n_removed (their characters).

    The first place of a unit, by doc_id (null first), then by text, then by position, keeps it. Lines under ``line_words``
    and texts under ``block_words`` words hold no such unit and stay. Null texts count as empty; rows equal in doc_id and text
    are one document; other columns are ignored.
    """
    from citeloom.llm.jaccard_join import NO_ID, keyed

    rows = keyed(docs)
    spans = repeated_spans(rows, line_words=line_words, block_words=block_words)
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = rows.join(spans, ["doc_id", "row_key"], "left").withColumn("removed", F.coalesce("removed", none))
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    ends = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.when(F.size("removed") > 0, kept).otherwise(F.col("text")).alias("text"),
                      "removed", F.aggregate("removed", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias("n_removed"))
