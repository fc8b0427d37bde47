"""Benchmark decontamination by pigeonhole edit matching, over words.

A test item of n words may differ in k = floor(rate * n) word edits. Cut into k + 1 pieces, at least one piece of it stands
untouched in any text within k edits; every hit of a piece is verified with Myers' bit-parallel distance around it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tasks import map_arrow
from citeloom.llm.words import Interned, pieces

#: Words of test items that one pass over the documents holds; more items take more passes.
BLOCK_WORDS = 2_000_000
#: Below this many words an item is reported only for a document that consists of it alone.
MIN_WORDS = 6
_MARKS = bytes(32 if not (chr(b).isalnum() or b > 127) else b for b in range(256))
_WIDE = re.compile("[‐-‧‰-⁞¡«·»¿ 　-〃]")


def plain(text: str) -> bytes:
    """Lower case, marks as spaces; one character stays one character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not low.isascii():
        low = _WIDE.sub(" ", low)
    return low.encode("utf-8", "replace").translate(_MARKS)


def cut(n: int, rate: float) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 pieces of an item of n words."""
    parts = min(n, int(rate * n) + 1)
    ends = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def myers(peq: dict[bytes, int], m: int, words: list[bytes], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of ``words``, and the (first) end of that stretch. Anchored: the
    stretch begins at the first word. Bits of one integer hold the differences of a column."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for at, word in enumerate(words, 1):
        eq = peq.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (mask & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & mask
        pv, mv = (mh << 1 & mask) | (mask & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, at
    return best, end


def pattern(words: list[bytes]) -> dict[bytes, int]:
    peq: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(words):
        peq[w] |= 1 << i
    return dict(peq)


@dataclass
class Items:
    """A block of test items and the hashes of their pieces by length."""

    rate: float
    words: list[list[bytes]] = field(default_factory=list)
    ids: list[int | None] = field(default_factory=list)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    size: int = 0

    def add(self, item_id: int | None, words: list[bytes]) -> None:
        self.ids.append(item_id)
        self.words.append(words)
        self.size += len(words)

    def close(self) -> "Items":
        """Sorted (hash, item, offset) of all pieces, for each length of a piece."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, words in enumerate(self.words):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            for start, n in cut(len(words), self.rate):
                found[n].append((int(rolling(h[start:start + n], n)[0]), i, start))
        for n, rows in found.items():
            rows.sort()
            self.tables[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64))
        return self

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of every stretch within an item's budget; offsets count characters."""
        plains = [plain(t) for t in texts]
        lists = [p.split() for p in plains]
        it = Interned(lists)
        h, rows, starts = it.hashes(), it.rows, it.starts
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, (keys, owner) in self.tables.items():
            if len(h) < n:
                continue
            runs = rolling(h, n)
            coarse = np.zeros(1 << 20, bool)
            coarse[(keys >> np.uint64(44)).astype(np.int64)] = True
            at = np.flatnonzero(coarse[(runs >> np.uint64(44)).astype(np.int64)])
            at = at[rows[at] == rows[at + n - 1]]
            lo, hi = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            for j, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                for item, offset in owner[a:b].tolist():
                    hits[int(rows[j]), item].append(j - int(starts[rows[j]]) - offset)
        offsets: dict[int, list[tuple[int, int]]] = {}
        for (row, item), begins in sorted(hits.items()):
            words, own = lists[row], self.words[item]
            if len(own) < MIN_WORDS and len(words) != len(own):
                continue
            for start, end, distance in self._verified(words, own, sorted(set(begins))):
                if row not in offsets:
                    offsets[row] = [m.span() for m in re.finditer(rb"\S+", plains[row])]
                a, b = offsets[row][start][0], offsets[row][end - 1][1]
                yield row, item, distance, len(plains[row][:a].decode("utf-8", "replace")), len(plains[row][:b].decode("utf-8", "replace"))

    def _verified(self, words: list[bytes], own: list[bytes], begins: list[int]) -> Iterator[tuple[int, int, int]]:
        n, budget = len(own), int(self.rate * len(own))
        peq, back = pattern(own), pattern(own[::-1])
        at = done = 0
        while at < len(begins):
            first = last = begins[at]
            while at < len(begins) and begins[at] <= min(last + n, first + 8 * n):  # hits of stretches that touch
                last = begins[at]
                at += 1
            lo, hi = max(done, first - budget), min(len(words), last + n + budget)
            for span in sorted(self._spans(words, own, peq, back, budget, lo, hi)):
                done = max(done, span[1])
                yield span

    @staticmethod
    def _spans(words, own, peq, back, budget, lo, hi) -> Iterator[tuple[int, int, int]]:
        """All stretches of words[lo:hi] within the budget: the best one, then those left and right of it."""
        n, rests = len(own), [(lo, hi)]
        while rests:
            lo, hi = rests.pop()
            distance, end = myers(peq, n, words[lo:hi])
            if distance > budget or not end:
                continue
            end += lo
            start = end - myers(back, n, words[max(lo, end - n - distance):end][::-1], anchored=True)[1]
            yield start, end, distance
            rests += [(a, b) for a, b in ((lo, start), (end, hi)) if b - a >= n - budget and b - a < hi - lo]


def item_blocks(benchmark: DataFrame, rate: float, block_words: int) -> Iterator[Items]:
    """The test items in blocks of about ``block_words`` words, streamed in order of item_id. Items without words are left out."""
    block = Items(rate)
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = plain(row["text"] or "").split()
        if words:
            block.add(row["item_id"], words)
        if block.size >= block_words:
            yield block.close()
            block = Items(rate)
    if block.size:
        yield block.close()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per stretch of a whole text that lies within ``rate`` * words edits of a test item: doc_id, item_id,
    distance (word edits), start and end (characters, end exclusive).

    Case, marks and white space do not count. Null and empty texts and items give no row; repeated rows give their rows
    again; null ids stay null; an empty benchmark gives an empty result; other columns are ignored.
    """
    schema = "doc_id long, item_id long, distance int, start long, end long"
    spark = docs.sparkSession

    def found(block: Items) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                ids = batch.column("doc_id").to_pylist()
                got = [(ids[row], held.value.ids[item], d, a, b) for row, item, d, a, b in held.value.leaks(batch.column("text").to_pylist())]
                if got:
                    yield pa.RecordBatch.from_pydict({
                        n: pa.array([g[k] for g in got], t) for k, (n, t) in enumerate((
                            ("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())))})

        return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema)

    parts = [found(b) for b in item_blocks(benchmark, rate, block_words)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no stretch near a test item; columns unchanged."""
    out = docs
    for block in item_blocks(benchmark, rate, block_words):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                bad = {row for row, *_ in held.value.leaks([t or "" for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        out = map_arrow(out, run, docs.schema)
    return out
