"""Token ids in a binary shard format: fixed-size id blocks, transposed into byte or bit planes, each plane compressed.

A shard holds whole documents in ascending doc_id order::

    magic "CLTP", version, planes per block, ids per block, ids, blocks, documents    (header, little endian)
    doc_id int64 and length uint32 of each document                                    (document index)
    for each block: ids uint32, then offset uint64 and size uint32 of each plane       (chunk index)
    the planes, each a zstandard frame

Spark stores shards as rows of a Parquet table (folder, range, shard, ids before it in its range, bytes): any file system
serves, a lost task writes its rows anew, and a reader decodes each row on its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.tasks import map_arrow
from citeloom.llm.words import pieces
from citeloom.session import new_location

MAGIC, VERSION = b"CLTP", 1
HEADER = struct.Struct("<4sHHIQII")
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20
CACHE_WORDS = 600_000
SHARD_SCHEMA = "range int, shard int, before long, ids long, first_doc long, payload binary"


# -- planes -------------------------------------------------------------------------------

def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block: 4 byte planes, or 32 bit planes, least significant first."""
    table = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(table[:, k]).tobytes() for k in range(4)]
    return [np.packbits((table[:, k] >> b) & 1).tobytes() for k in range(4) for b in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    table = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            table[:, k] = np.frombuffer(p, np.uint8)
    else:
        for at, p in enumerate(planes):
            table[:, at // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (at % 8)
    return table.reshape(-1).view("<u4")


def write_shard(doc_ids: list[int], lens: list[int], ids: np.ndarray, *, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    blocks = [ids[i:i + block_ids] for i in range(0, len(ids), block_ids)]
    n_planes = 32 if bits else 4
    head = HEADER.pack(MAGIC, VERSION, n_planes, block_ids, len(ids), len(blocks), len(doc_ids))
    docs = np.array(doc_ids, "<i8").tobytes() + np.array(lens, "<u4").tobytes()
    at = len(head) + len(docs) + len(blocks) * (4 + 12 * n_planes)
    index, body = [], []
    for block in blocks:
        index.append(struct.pack("<I", len(block)))
        for plane in to_planes(block, bits):
            frame = pack(plane)
            index.append(struct.pack("<QI", at, len(frame)))
            body.append(frame)
            at += len(frame)
    return b"".join([head, docs, *index, *body])


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a shard."""
    magic, version, n_planes, _, n_ids, n_blocks, n_docs = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard")
    at = HEADER.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lens = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for _ in range(n_blocks):
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        planes = []
        for _ in range(n_planes):
            offset, size = struct.unpack_from("<QI", data, at)
            planes.append(unpack(data[offset:offset + size]))
            at += 12
        out.append(from_planes(planes, n))
    ids = np.concatenate(out) if out else np.zeros(0, "<u4")
    if len(ids) != n_ids:
        raise ValueError("shard is cut")
    return doc_ids, lens, ids


def read_block(data: bytes, block: int) -> np.ndarray:
    """One block by the chunk index, without touching the others."""
    _, _, n_planes, _, _, n_blocks, n_docs = HEADER.unpack_from(data)
    if not 0 <= block < n_blocks:
        raise IndexError(block)
    at = HEADER.size + 12 * n_docs + block * (4 + 12 * n_planes)
    (n,) = struct.unpack_from("<I", data, at)
    spans = [struct.unpack_from("<QI", data, at + 4 + 12 * k) for k in range(n_planes)]
    return from_planes([zstandard.ZstdDecompressor().decompress(data[o:o + s]) for o, s in spans], n)


# -- tokenizing ---------------------------------------------------------------------------

_EDGE = re.compile(r" (?=[^\s\x00-\x1f])")
class OddSpace(Exception):
    """A piece that is empty or starts with a space or control character: its text may not be cut at every space."""


_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,./:;?|-]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,./:;?|-]*))?")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself where printable, else the next free code
    point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    return struct.pack(f"<{len(ids)}I", *ids)


def cuts_at_spaces(tokenizer) -> bool:
    """True for byte-level BPE with the usual pattern of words and without normalisation, where pieces can be encoded alone."""
    spec = json.loads(tokenizer.to_str())
    first, model = spec["pre_tokenizer"] or {}, spec["model"]
    return (first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first["add_prefix_space"] and not spec["normalizer"]
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] or t["content"].isalpha() for t in spec["added_tokens"]))


class PieceIds(dict):
    """Ids of pieces as little-endian uint32, encoded on first use: words by the library's model, other pieces whole."""

    def __init__(self, tokenizer, before: str, parts: dict[str, bytes]) -> None:
        self.tokenizer, self.model, self.before, self.parts, self.letters = tokenizer, tokenizer.model, before, parts, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if self.before and (piece[:1] <= "\x1f" or piece[0].isspace()):
            raise OddSpace
        plain = _PLAIN.fullmatch(self.before + piece)
        if plain:
            out = b"".join([self.part(p) for p in plain.groups() if p])
        else:
            out = self.whole(self.before + piece)
        self[piece] = out
        return out

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, text: str) -> bytes:
        """Ids of one run of letters (with a space before it or not), of marks, or of a line break."""
        ids = self.parts.get(text)
        if ids is None:
            if text[-1].isalpha():
                shown = text.replace(" ", self.letters[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
                ids = packed([t.id for t in self.model.tokenize(shown)])
            else:
                ids = self.whole(text)
            self.parts[text] = ids
        return ids


class WordCachedTokenizer:
    """Ids as the library gives them for whole texts. Byte-level BPE never joins across a space that a visible character
    follows, nor between letters, marks and line breaks, so texts are cut there and each distinct piece is encoded once. The
    caches are emptied when full. Tokenizers of other kinds encode every text whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_at_spaces(self.tokenizer)
        self.reset()

    def reset(self) -> None:
        parts: dict[str, bytes] = {}
        self.first, self.rest = PieceIds(self.tokenizer, "", parts), PieceIds(self.tokenizer, " ", parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        if len(self.rest) + len(self.first) > CACHE_WORDS:
            self.reset()
        return list(map(self.cut if self.cuts else self.first.whole, texts))

    def cut(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except OddSpace:
            head, *tail = _EDGE.split(text)
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer_of(path: str) -> WordCachedTokenizer:
    """One per Python worker, kept from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordCachedTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- Spark --------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS,
                 block_ids: int = BLOCK_IDS, bits: bool = False, ranges: int | None = None) -> None:
    """Write the ids of all whole texts, ``end_id`` after each, as shards in ascending doc_id order (null first).

    Documents are range-partitioned by doc_id; a task walks its range in order and closes a shard once it holds
    ``shard_ids`` ids, so it never holds more than one shard and one piece of text. Null and empty texts give the end id
    alone; equal doc_ids stay separate, in the order of their texts; a null doc_id is stored as the smallest integer.
    """
    order = ["doc_id", "text"]
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (rows.repartitionByRange(ranges, "doc_id") if ranges else rows.repartitionByRange("doc_id")).sortWithinPartitions(*order)
    rows = rows.withColumn("range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, shard, before = 0, 0, 0
        doc_ids: list[int] = []
        lens: list[int] = []
        held: list[bytes] = []
        count = 0

        def flush() -> pa.RecordBatch:
            payload = write_shard(doc_ids, lens, np.frombuffer(b"".join(held), "<u4"), block_ids=block_ids, bits=bits)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()),
                pa.array([doc_ids[0]], pa.int64()), pa.array([payload], pa.binary())], names=["range", "shard", "before", "ids", "first_doc", "payload"])

        for batch in pieces(batches, "text"):
            part = batch.column("range")[0].as_py()
            for doc, data in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(doc)
                held.append(data + end)
                lens.append(len(data) // 4 + 1)
                count += lens[-1]
                if count >= shard_ids:
                    yield flush()
                    shard, before = shard + 1, before + count
                    doc_ids, lens, held, count = [], [], [], 0
        if doc_ids:
            yield flush()

    map_arrow(rows, run, SHARD_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored document, from the shards alone: doc_id, start (ids of all documents before it), n_tokens (with
    the end id) and ids_crc32 (of its ids as little-endian uint32)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    sizes = {r["range"]: r["n"] for r in shards.groupBy("range").agg(F.sum("ids").alias("n")).collect()}  # one row per range
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizers.clear()  # encoding is over: a worker that later stages reuse holds no caches
        for batch in batches:
            for part, before, payload in zip(*(batch.column(c).to_pylist() for c in ("range", "before", "payload")), strict=True):
                doc_ids, lens, ids = read_shard(payload)
                ends = np.cumsum(lens.astype(np.int64))
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids), pa.array(first[part] + before + ends - lens), pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = map_arrow(shards.select("range", "before", "payload"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def encode_documents(docs: DataFrame, *, tokenizer: str | None = None, **options) -> DataFrame:
    """Write the token shards of ``docs`` to a fresh folder of the shared directory and read them back."""
    folder = new_location(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer=tokenizer or default_tokenizer(), **options)
    return read_tokens(docs.sparkSession, folder)
