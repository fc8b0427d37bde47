"""Exact dedup: sorted runs of digests merged over partitions in binomial rounds.

Every partition of the texts is a slot that holds one sorted run: an entry per distinct digest, with the row that would stay
and the number of rows. In each round 16 neighbouring slots exchange: each cuts its run by the next bits of the digest, and
what falls into one range of digests meets in one task, which merges the slices and keeps the best row of equal entries. So
the ranges narrow as the clusters of slots widen, a task holds about one slot's worth of entries in every round, and a group of
copies counts once per slot however many rows it has. After log16(slots) rounds each range is whole. Answers go back over
(slot, digest) rows, never over all rows of a group.

Null and empty texts are equal to each other and to texts of white space. Rows without doc_id stay rows: as keepers they come
after all others. Of rows that tie in everything the first in reading order stays. Columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tasks import group_arrow, map_arrow
from citeloom.llm.words import pieces, utf8
from citeloom.session import materialise

SPACES = bytes([0x20, *range(0x09, 0x0E)])
ROUND_BITS = 4
TASK_ENTRIES = 500_000
NO_ID = np.iinfo(np.int64).max
#: One entry of a run. ``d0`` is the digest's first eight bytes as a number, the sort key; the rest verifies a match.
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("size", "<i8"), ("points", "<i8"), ("no_id", "u1"),
                  ("doc", "<i8"), ("slot", "<i4"), ("at", "<i8"), ("rows", "<i8")])
DIGEST = ("d0", "d1", "d2", "d3")


def marks(docs: DataFrame, *carry: str) -> DataFrame:
    """Written table, one narrow row per text: slot, at (place in the slot), doc_id, digest, size (bytes of the text without
    white space), points (code points of the text as it is), and the ``carry`` columns in one struct."""
    row = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.spark_partition_id().alias("slot"), *row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in pieces(batches, "text"):
            bare = [t.translate(None, SPACES) for t in utf8(batch.column("text"))]
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("slot"), pa.array(np.arange(at, at + batch.num_rows)), batch.column("doc_id"),
                pa.array([hashlib.sha256(t).digest() for t in bare], pa.binary()), pa.array([len(t) for t in bare], pa.int64()), points,
                *(batch.column(c) for c in ["row"] if carry)], names=names)
            at += batch.num_rows

    schema = "slot int, at long, doc_id long, digest binary, size long, points long"
    names = [c.split()[0] for c in schema.split(", ")] + ["row"] * bool(carry)
    if carry:
        schema += f", row {rows.schema['row'].dataType.simpleString()}"
    return materialise(map_arrow(rows, run, schema), "digests")


def entries_of(batch: pa.RecordBatch) -> np.ndarray:
    """Entries of marked rows, one each."""
    out = np.zeros(batch.num_rows, ENTRY)
    words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
    for k, name in enumerate(DIGEST):
        out[name] = words[:, k]
    for name in ("size", "points", "slot", "at"):
        out[name] = batch.column(name).to_numpy(zero_copy_only=False)
    out["no_id"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    out["doc"] = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    out["rows"] = 1
    return out


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several: equal digests become one entry that keeps the row with most code points, then the smallest
    doc_id, then the first place, and the sum of rows. Entries whose heads agree are one only if whole digest and size agree."""
    both = np.concatenate(runs) if runs else np.zeros(0, ENTRY)
    if not len(both):
        return both
    both = both[np.argsort(both["d0"], kind="stable")]  # a stable sort finds the runs and merges them
    near = both["d0"][1:] == both["d0"][:-1]
    same = near.copy()
    for name in (*DIGEST[1:], "size"):
        same &= both[name][1:] == both[name][:-1]
    if (near & ~same).any():  # different texts under one head: order by the whole digest
        both = both[np.lexsort((both["size"], both["d3"], both["d2"], both["d1"], both["d0"]))]
        same = np.ones(len(both) - 1, bool)
        for name in (*DIGEST, "size"):
            same &= both[name][1:] == both[name][:-1]
    first = np.flatnonzero(np.r_[True, ~same])
    if len(first) == len(both):
        return both
    group = np.cumsum(np.r_[True, ~same]) - 1
    order = np.lexsort((both["at"], both["slot"], both["doc"], both["no_id"], -both["points"], group))
    out = both[order[first]]
    out["rows"] = np.add.reduceat(both["rows"], first)
    return out


def cut_run(run: np.ndarray, slot: int, bits: int) -> pa.RecordBatch:
    """Slices of a run by the first ``bits`` bits of its digests, each a row addressed to (slot, range)."""
    key = run["d0"] >> np.uint64(64 - bits)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(first), slot, np.int32)), pa.array(key[first].astype(np.int64)),
        pa.array([x.tobytes() for x in np.split(run, first[1:])], pa.binary())], names=["slot", "range", "run"])


RUN_SCHEMA = "slot int, range long, run binary"


def merged_groups(marked: DataFrame, *, round_bits: int = ROUND_BITS, task_entries: int = TASK_ENTRIES) -> DataFrame:
    """Groups of more than one row: digest, keep_id, keep_slot, keep_at, group_size; by rounds of exchanges and merges."""
    shape = marked.groupBy("slot").agg(F.count("*").alias("n")).agg(F.max("slot").alias("last"), F.max("n").alias("most")).first()
    slots, most = (shape["last"] or 0) + 1, shape["most"] or 1
    rounds = max(1, -(-(slots - 1).bit_length() // round_bits))
    extra = max(0, (most // task_entries).bit_length())

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = entries_of(batch)
            for part in np.split(rows, np.flatnonzero(np.diff(rows["slot"])) + 1):
                if held and (held[0]["slot"][0] != part["slot"][0] or sum(map(len, held)) > task_entries):
                    yield cut_run(merge_runs(held), int(held[0]["slot"][0]) >> round_bits, extra + round_bits)
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield cut_run(merge_runs(held), int(held[0]["slot"][0]) >> round_bits, extra + round_bits)

    def meet(table: pa.Table) -> np.ndarray:
        return merge_runs([np.frombuffer(x, ENTRY) for x in table.column("run").to_pylist()])

    def exchange(bits: int):
        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([cut_run(meet(table), table.column("slot")[0].as_py() >> round_bits, bits)])
        return run

    def close(table: pa.Table) -> pa.Table:
        out = meet(table)
        out = out[out["rows"] > 1]
        words = np.stack([out[n] for n in DIGEST], 1).astype(">u8").tobytes()
        return pa.table([
            pa.array([words[i:i + 32] for i in range(0, len(words), 32)], pa.binary()), pa.array(out["doc"], mask=out["no_id"] == 1),
            pa.array(out["slot"].astype(np.int32)), pa.array(out["at"].astype(np.int64)), pa.array(out["rows"].astype(np.int64))],
            names=["digest", "keep_id", "keep_slot", "keep_at", "group_size"])

    runs = map_arrow(marked.select("slot", "at", "doc_id", "digest", "size", "points"), leaves, RUN_SCHEMA)
    for r in range(2, rounds + 1):
        runs = group_arrow(runs.groupBy("slot", "range"), exchange(extra + round_bits * r), RUN_SCHEMA)
    return group_arrow(runs.groupBy("slot", "range"), close, "digest binary, keep_id long, keep_slot int, keep_at long, group_size long")


def answered(marked: DataFrame, **options) -> DataFrame:
    """Marked rows with keep_id, group_size and kept. A slot asks once for each of its digests, so the join on the digest sees
    a group of copies once per slot, and the join back sees one slot's share of it."""
    groups = merged_groups(marked, **options)
    answers = marked.select("slot", "digest").distinct().join(groups, "digest")
    single = F.col("group_size").isNull()
    return marked.join(answers, ["slot", "digest"], "left").withColumns({
        "keep_id": F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")),
        "kept": single | ((F.col("slot") == F.col("keep_slot")) & (F.col("at") == F.col("keep_at"))),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})


def exact_copies(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256."""
    return answered(marks(docs), **options).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def first_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    return answered(marks(docs, *docs.columns), **options).filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
