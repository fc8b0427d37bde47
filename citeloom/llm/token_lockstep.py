"""Cross-tokenizer alignment: where tokens of two vocabularies end at the same byte of a text.

A batch of documents is one string of bytes with two lists of token ends. Every document, long ones cut into lanes of
``LANE_BYTES``, has a pair of pointers; one NumPy state vector moves all of them at once: the pointer with the smaller end
advances, equal ends emit a link and a cut and advance both, finished lanes are compacted away. A lane begins at the first ends
beyond its border, which is the state that a walk from the document's start reaches there, so lanes change nothing.

Two tokens that end together share their last bytes, so one is a suffix of the other: there are at most as many id pairs as
the two vocabularies hold bytes (about half a million here), however large the corpus. That bounds the table of pair counts
that is sent to all tasks.

Null and empty texts, and texts that one of the vocabularies does not give back byte by byte, have no tokens. Rows stay rows:
repeated and null doc_ids are carried as they are. Other columns are ignored and may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tasks import map_arrow
from citeloom.llm.token_planes import WordCachedTokenizer, byte_letters
from citeloom.llm.words import pieces
from citeloom.session import new_location

LANE_BYTES = 1024
BATCH_BYTES = 2 << 20
CACHE_CHUNKS = 400_000
MARK = "▁"


# -- vocabularies -------------------------------------------------------------------------

class ByteLevelVocabulary:
    """Tokens of a byte-level BPE file; their strings in a text are plain text."""

    def __init__(self, path: str) -> None:
        kind = json.loads(Path(path).read_text())
        before = kind.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or kind["model"]["type"] != "BPE":
            raise ValueError("not a byte-level BPE")
        self.own = WordCachedTokenizer(path)
        self.tokenizer = self.own.tokenizer
        self.tokenizer.encode_special_tokens = True
        self.cuts_hold = kind.get("normalizer") is None and not before.get("add_prefix_space") and before.get("use_regex", True)
        back = {letter: b for b, letter in byte_letters().items()}
        self.tokens = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, at in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[at] = bytes(back[x] for x in token) if all(x in back for x in token) else token.encode()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of a space and each text."""
        spaced = [f" {t}" for t in texts]
        if self.cuts_hold:
            return self.own.encode(spaced)
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(spaced, add_special_tokens=False)]


class PieceVocabulary:
    """Tokens of a sentence-piece file. If no piece holds a space mark behind another character, no merge crosses a single
    space between two words: texts are cut there and each distinct part is encoded once."""

    _EDGE = re.compile(r"(?<=[^ ]) (?=[^ ])")

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.cuts_hold = all(MARK not in n.lstrip(MARK) for n in names)
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text; the model puts a space before it."""
        if not self.cuts_hold:
            return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]
        parts = [t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else self._EDGE.split(t) for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        new = [p for p in set().union(*parts) if p not in self.cache]
        for part, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.cache[part] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(self.cache.__getitem__, p)) for p in parts]


@dataclass(frozen=True)
class Pair:
    """Paths of the two vocabularies."""

    a: str
    b: str

    @staticmethod
    def default() -> Pair:
        import public_tokenizers as files

        return Pair(files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


class Vocabularies:
    """Both vocabularies and their tables, once per Python worker."""

    def __init__(self, pair: Pair) -> None:
        self.a, self.b = ByteLevelVocabulary(pair.a), PieceVocabulary(pair.b)
        self.size = [np.array([len(t) for t in v.tokens], np.int64) for v in (self.a, self.b)]
        self.bytes = [pa.array(v.tokens, pa.large_binary()) for v in (self.a, self.b)]

    @property
    def pair_bound(self) -> int:
        """No more id pairs than this can end together."""
        return int(self.size[0].sum() + self.size[1].sum()) * 2

    @cached_property
    def written(self) -> pa.Array:
        """Each id as decimals, first with a comma, then with a bar, then with a semicolon behind it."""
        n = max(len(self.a.tokens), len(self.b.tokens))
        return pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(n)], pa.large_binary())


_loaded: dict[Pair, Vocabularies] = {}


def vocabularies(pair: Pair) -> Vocabularies:
    if pair not in _loaded:
        _loaded[pair] = Vocabularies(pair)
    return _loaded[pair]


# -- alignment ----------------------------------------------------------------------------

def lockstep(end_a: np.ndarray, end_b: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both lists of all common ends, ascending. ``borders`` begins with 0 and ends with the last end; lane k
    takes the ends in (borders[k], borders[k + 1]]."""
    at_a, at_b = np.searchsorted(end_a, borders, side="right"), np.searchsorted(end_b, borders, side="right")
    a, b, stop_a, stop_b = at_a[:-1].copy(), at_b[:-1].copy(), at_a[1:], at_b[1:]
    links_a: list[np.ndarray] = []
    links_b: list[np.ndarray] = []
    while True:
        live = (a < stop_a) & (b < stop_b)
        if not live.all():  # compact finished lanes
            a, b, stop_a, stop_b = a[live], b[live], stop_a[live], stop_b[live]
        if not len(a):
            break
        x, y = end_a[a], end_b[b]
        same = x == y
        links_a.append(a[same])
        links_b.append(b[same])
        a, b = a + (x <= y), b + (y <= x)
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def lane_borders(doc_ends: np.ndarray, lane_bytes: int) -> np.ndarray:
    """Ends of documents, and a border every ``lane_bytes`` inside longer ones."""
    starts = np.r_[0, doc_ends[:-1]]
    more = np.maximum(0, -(-(doc_ends - starts) // lane_bytes) - 1)
    inside = np.repeat(starts, more) + lane_bytes * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.unique(np.r_[0, doc_ends, inside])


@dataclass
class Aligned:
    """Token ids of all documents of a batch, the places where links stand, and where each document begins in each."""

    ids: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]
    starts: tuple[np.ndarray, np.ndarray]
    link_starts: np.ndarray


def align(texts: list[str], v: Vocabularies, lane_bytes: int = LANE_BYTES) -> Aligned:
    """Align whole texts; those without tokens get empty shares."""
    usable = [i for i, t in enumerate(texts) if t and MARK not in t]  # that mark reads back as a space
    while True:
        raw = [t.encode() for t in (texts[i] for i in usable)]
        coded = [side.encode([texts[i] for i in usable]) if usable else [] for side in (v.a, v.b)]
        ids = tuple(np.frombuffer(b"".join(c), "<u4") for c in coded)
        whole = b"".join(x for t in raw for x in (b" ", t))
        if all(joined(table, x) == whole for table, x in zip(v.bytes, ids, strict=True)):
            break
        usable = [i for i, t, *both in zip(usable, raw, *coded, strict=True)
                  if all(joined(table, np.frombuffer(x, "<u4")) == b" " + t for table, x in zip(v.bytes, both, strict=True))]
    counts = []
    for c in coded:
        n = np.zeros(len(texts), np.int64)
        n[usable] = [len(x) // 4 for x in c]
        counts.append(n)
    starts = tuple(np.r_[0, np.cumsum(n)] for n in counts)
    ends = tuple(np.cumsum(size[x]) for size, x in zip(v.size, ids, strict=True))
    doc_ends = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)
    links = lockstep(*ends, lane_borders(doc_ends, lane_bytes)) if usable else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Aligned(ids, links, starts, np.searchsorted(links[0], starts[0]))


def joined(table: pa.Array, ids: np.ndarray) -> bytes:
    """Bytes of tokens in a row."""
    return _flat(table.take(pa.array(ids)))[0].tobytes()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a fresh binary column, and where each value begins."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1)
    return np.frombuffer(data, np.uint8, at[-1]) if data else np.zeros(0, np.uint8), at


def group_digests(x: Aligned, v: Vocabularies) -> list[str]:
    """SHA-256 of each document's groups, written ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    (ids_a, ids_b), (cut_a, cut_b) = x.ids, x.links
    n = len(v.written) // 3
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[cut_a], mark_b[cut_b] = n, 2 * n
    group_a, group_b = (np.cumsum(m > 0) - (m > 0) for m in (mark_a, mark_b))
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.r_[0, cut_b + 1][group_a]] = ids_a + mark_a  # behind the B tokens of earlier groups
    codes[np.arange(len(ids_b)) + (cut_a + 1)[group_b]] = ids_b + mark_b  # and behind the group's own A tokens
    data, at = _flat(v.written.take(pa.array(codes)))
    borders = at[x.starts[0] + x.starts[1]].tolist()
    return [hashlib.sha256(data[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(borders, borders[1:])]


# -- Spark --------------------------------------------------------------------------------

def aligned_documents(docs: DataFrame, pair: Pair | None = None) -> DataFrame:
    """Per row: doc_id, ids_a, ids_b, link_a, link_b: all token ids, and the places in them of tokens that end together; link
    i closes group i."""
    pair = pair or Pair.default()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(pair)
        for batch in pieces(batches, "text", BATCH_BYTES):
            x = align([t or "" for t in batch.column("text").to_pylist()], v)
            lists = [pa.ListArray.from_arrays(pa.array(s.astype(np.int32)), pa.array(i.astype(np.int32))) for s, i in zip(x.starts, x.ids, strict=True)]
            for k in (0, 1):
                inside = x.links[k] - np.repeat(x.starts[k][:-1], np.diff(x.link_starts))
                lists.append(pa.ListArray.from_arrays(pa.array(x.link_starts.astype(np.int32)), pa.array(inside.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "ids_a", "ids_b", "link_a", "link_b"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, ids_a array<int>, ids_b array<int>, link_a array<int>, link_b array<int>")


DIGEST_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def linked_pairs(docs: DataFrame, pair: Pair) -> DataFrame:
    """Written table per row: counts, digest of the groups, and the id pair of each link as little-endian uint64
    (id of A times size of B plus id of B; uint32 where all pairs fit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(pair)
        wide = np.uint64(len(v.b.tokens))
        kind = pair_type(v)
        for batch in pieces(batches, "text", BATCH_BYTES):
            x = align([t or "" for t in batch.column("text").to_pylist()], v)
            keys = (x.ids[0][x.links[0]].astype(np.uint64) * wide + x.ids[1][x.links[1]]).astype(kind).tobytes()
            n = np.diff(x.link_starts)
            step = np.dtype(kind).itemsize
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((x.link_starts * step).astype(np.int64)), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(x.starts[0])), pa.array(np.diff(x.starts[1])), pa.array(n), pa.array(n),
                pa.array(group_digests(x, v)), held.cast(pa.binary())], names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = new_location(docs.sparkSession, "linked")
    map_arrow(rows, run, DIGEST_SCHEMA).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(DIGEST_SCHEMA).parquet(folder)


def pair_type(v: Vocabularies) -> str:
    return "<u4" if len(v.a.tokens) * len(v.b.tokens) < 2**32 else "<u8"


def pair_counts(linked: DataFrame, pair: Pair) -> DataFrame:
    """(pair, n): how many links of the corpus hold the pair; counted inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pair_type(vocabularies(pair))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for rows in range(0, batch.num_rows, 512):
                keys = np.frombuffer(b"".join(batch.column("pairs").slice(rows, 512).to_pylist()), kind)
                held.append(np.unique(keys, return_counts=True))
                if len(held) > 16:
                    held = [summed(held)]
        if held:
            keys, n = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return map_arrow(linked.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return keys, n


def alignment_digests(docs: DataFrame, pair: Pair | None = None) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id), count_sum
    (corpus counts of its links' pairs, summed), groups_sha256."""
    pair = pair or Pair.default()
    linked = linked_pairs(docs, pair)
    v = vocabularies(pair)
    found = pair_counts(linked, pair).limit(v.pair_bound + 1).toPandas()
    if len(found) > v.pair_bound:
        raise AssertionError("more id pairs than two vocabularies can link")
    keys, n = found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    best = np.zeros(len(v.b.tokens), np.int64)
    np.maximum.at(best, keys % len(v.b.tokens), n)
    sent = docs.sparkSession.sparkContext.broadcast((keys.astype(np.uint64), n, n == best[keys % len(v.b.tokens)]))  # pair_bound rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pair_type(vocabularies(pair))
        all_keys, all_n, top = sent.value
        all_keys = all_keys.astype(kind)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                held = batch.column("pairs").to_pylist()
                ends = np.r_[0, np.cumsum([len(x) for x in held])] // np.dtype(kind).itemsize
                at = np.searchsorted(all_keys, np.frombuffer(b"".join(held), kind))
                sums = [np.r_[0, np.cumsum(x)] for x in (top[at].astype(np.int64), all_n[at])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=[*names, "n_best", "count_sum"])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return map_arrow(linked, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
