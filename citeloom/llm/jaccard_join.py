"""Exact n-gram Jaccard join by prefix lists with set-relation skipping.

Index level: a list falls into blocks of like size; blocks that size and position rule out are skipped whole, and of lists that
hold the same sets one is read. Pairs are bounded by short heads of their sets before a whole set is read. Answer level: each list has a pivot set, and every member's exact similarity to it is computed once. With
d = 1 - Jaccard (a metric) and x within 1 - t of the pivot, a set further than 2 (1 - t) from the pivot cannot link to x, so
the answers of x follow from those of its pivot without being searched; and sets already in one component need no answers
against each other. A group of m near copies therefore costs about m comparisons instead of m * m.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeloom.llm.components import components
from citeloom.llm.tasks import group_arrow, map_arrow
from citeloom.llm.words import Interned, lower_words, pieces, utf8
from citeloom.session import at_most, broadcast_if, materialise

#: Counters of the frequency sketch: a fixed number, so what reaches the driver and the executors has a fixed size.
SKETCH_BITS = 22
SKETCH_CHUNKS = 64
#: Sets to be fetched are broadcast as ids up to this many; beyond it they meet in a shuffled join.
BROADCAST_IDS = 1_000_000
#: Pivot rounds before the remaining pairs are compared one by one.
ROUNDS = 2
#: Longs of a head's bitmap, a fixed number, and their columns.
BITMAP_WORDS = 4
BITMAP = tuple(f"bits{i}" for i in range(BITMAP_WORDS))
NO_ID = -(2**63)


# -- sets of one batch ----------------------------------------------------------------------

def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles; of all words if there are fewer than n."""
    it = Interned(map(lower_words, texts))
    h, starts = it.hashes(), it.starts
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            rolled = (rolled + h[k:k + len(rolled)]) * odd
            rolled ^= rolled >> np.uint64(29)
    out = []
    for at, size in zip(starts.tolist(), it.lens.tolist()):
        if size >= n:
            out.append(np.unique(rolled[at:at + size - n + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at:at + size].tobytes(), seed=size)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=1) - 2**63 if len(tokens) else NO_ID


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def head_length(n: int, percent: int) -> int:
    """Enough of a set to tell most sets apart by an upper bound: its prefix and a sixth of the set more."""
    return min(n, prefix_length(n, percent) + n // 6)


# -- passes over the texts ------------------------------------------------------------------

FACTS = "doc_id long, row_key long, n int, sid long, chunk int, counts binary"


def set_facts(docs: DataFrame, n: int) -> DataFrame:
    """One row per document (doc_id, row_key, n, sid), and the token counts of each task as compressed sketch chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in pieces(batches, "text"):
            sets = shingle_sets(utf8(batch.column("text")), n)
            sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row_key"), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([set_id(s) for s in sets], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if sketch.any():
            chunks = [zstandard.compress(c.tobytes()) for c in np.split(sketch, SKETCH_CHUNKS)]
            none = pa.nulls(len(chunks), pa.int64())
            yield pa.RecordBatch.from_arrays([
                none, none, pa.nulls(len(chunks), pa.int32()), none, pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=names)

    names = ["doc_id", "row_key", "n", "sid", "chunk", "counts"]
    return materialise(map_arrow(docs.select("doc_id", "row_key", "text"), run, FACTS), "set_facts")


def frequency_levels(facts: DataFrame) -> np.ndarray:
    """The summed sketch as powers of two, one byte a counter (4 MB). It only orders tokens, rare first; any order is exact."""

    def add(table):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNKS, np.uint64)
        for data in table.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(data), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([zstandard.compress(total.tobytes())], pa.binary())})

    part = facts.filter("chunk is not null").select("chunk", "counts")
    some = group_arrow(part.groupBy("chunk", F.pmod(F.xxhash64("counts"), F.lit(256))), add, "chunk int, counts binary")
    rows = group_arrow(some.groupBy("chunk"), add, "chunk int, counts binary").collect()  # SKETCH_CHUNKS rows of fixed size
    total = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_BITS) // SKETCH_CHUNKS), np.uint32)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.uint32)
    return np.ceil(np.log2(total.reshape(-1) + 1.0)).astype(np.uint8)


def prints(tokens: np.ndarray) -> np.ndarray:
    """Short prints of a head's tokens, up to the first print that repeats: an intersection counts equal prints once, and a
    shorter head only loosens the bound."""
    short = tokens.astype(np.uint32)
    order = np.argsort(short, kind="stable")
    again = order[1:][short[order][1:] == short[order][:-1]]
    return short[:again.min() if len(again) else len(short)].view(np.int32)


def print_bits(short: np.ndarray) -> list[int]:
    """The prints as a bitmap of ``BITMAP_WORDS`` longs: each print sets the bit of its last eight binary digits."""
    words = np.zeros(BITMAP_WORDS, np.uint64)
    bit = short.view(np.uint32) & np.uint32(64 * BITMAP_WORDS - 1)
    np.bitwise_or.at(words, bit >> np.uint32(6), np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64))
    return words.view(np.int64).tolist()


def set_heads(docs: DataFrame, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """One row per distinct set: sid, n, its prefix (tokens, rarest first in the global order), its head, short prints of a
    longer prefix, and the head's bitmap. A print stands for its token in upper bounds only, where an accidental match of two
    sets does no harm."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = held.value, set()
        for batch in pieces(batches, "text"):
            sids, sizes, prefixes, heads, bits = [], [], [], [], []
            for s in shingle_sets(utf8(batch.column("text")), n):
                sid = set_id(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                first = s[np.argsort(level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:head_length(len(s), percent)]]
                sids.append(sid)
                sizes.append(len(s))
                prefixes.append(first[:prefix_length(len(s), percent)].view(np.int64))
                heads.append(prints(first))
                bits.append(print_bits(heads[-1]))
            if sids:
                yield pa.RecordBatch.from_arrays([
                    pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int32())),
                    *(pa.array(w, pa.int64()) for w in zip(*bits))], names=["sid", "n", "prefix", "head", *BITMAP])

    rows = map_arrow(docs.select("text"), run, "sid long, n int, prefix array<long>, head array<int>" + "".join(f", {w} long" for w in BITMAP))
    return materialise(rows.dropDuplicates(["sid"]), "heads")


def fetch_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, tokens) of the wanted sets, each computed anew from the one document that stands for it (sid, doc_id, row_key)."""
    keys = materialise(wanted.select(F.col("sid").alias("want"), "doc_id", "row_key"), "wanted")
    few = at_most(keys, BROADCAST_IDS)
    rows = docs.join(broadcast_if(keys, few), ["doc_id", "row_key"]).select("want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(utf8(batch.column("text")), n)
            yield pa.RecordBatch.from_arrays([batch.column("want"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "tokens"])

    return materialise(map_arrow(rows, run, "sid long, tokens array<long>"), "sets")


# -- comparing ------------------------------------------------------------------------------

def linked(both: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * both >= percent * (a + b - both)


def with_both(pairs: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b, ...) with the columns of both sets, as a_... and b_... ."""
    for c in ("a", "b"):
        pairs = pairs.join(side.select(F.col("sid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns)), c)
    return pairs


def at_most_common(a_n: Column, a_head: Column, b_n: Column, b_head: Column) -> Column:
    """An upper bound of an intersection: the head that ends first in the global order holds all shared tokens up to its end,
    so it is what both heads share and the longer rest."""
    return F.least(F.size(F.array_intersect(a_head, b_head)) + F.greatest(a_n - F.size(a_head), b_n - F.size(b_head)), a_n, b_n)


def at_most_common_bits(a_n: Column, a_size: Column, a_bits: list[Column], b_n: Column, b_size: Column, b_bits: list[Column]) -> Column:
    """``at_most_common`` from the heads' sizes and bitmaps, never smaller: each bit that one head has alone is a token that it
    does not share."""

    def shared(size: Column, x: list[Column], y: list[Column]) -> Column:
        return size - sum(F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in zip(x, y, strict=True))

    both = F.least(shared(a_size, a_bits, b_bits), shared(b_size, b_bits, a_bits))
    return F.least(both + F.greatest(a_n - a_size, b_n - b_size), a_n, b_n)


def possible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs whose heads leave room for ``percent`` of similarity."""
    a_n, b_n = F.col("a_n"), F.col("b_n")
    most = at_most_common(a_n, F.col("a_head"), b_n, F.col("b_head"))
    return with_both(pairs, heads, "head").filter(linked(most, a_n, b_n, percent)).select(*pairs.columns)


def overlaps(docs: DataFrame, owners: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``pairs`` (a, b, ...) with ``both``, the exact size of the intersection, from the sets of their documents."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    sets = fetch_sets(docs, owners.join(wanted, "sid", "left_semi"), n)
    both = with_both(pairs, sets, "tokens").withColumn("both", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return both.select(*pairs.columns, "both").distinct()


def set_components(docs: DataFrame, facts: DataFrame, *, n: int, percent: int) -> DataFrame:
    """(sid, root): root names the component of linked sets; sets without a link to another are left out."""
    levels = frequency_levels(facts)
    owners = facts.filter("chunk is null and n > 0").groupBy("sid").agg(
        F.min(F.struct("doc_id", "row_key")).alias("_own"), F.count("*").alias("copies")).select("sid", "_own.doc_id", "_own.row_key", "copies")
    owners = materialise(owners, "owners")
    heads = set_heads(docs, levels, n, percent)
    entries = heads.select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("_m")).filter("_m > 1").select("token")
    entries = materialise(_skip_blocks(entries.join(shared, "token"), percent), "entries")
    live = _one_list_each(entries).join(owners.select("sid", "copies"), "sid").withColumn("root", F.col("sid"))
    live = materialise(live, "lists")

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    for k in range(ROUNDS):
        live, new = _pivot_round(docs, owners, heads, live, n, percent, k)
        links = links.union(new)
        live = _unsettled(live, components(links))
    pairs = materialise(_open_pairs(live, heads, percent), "pairs")
    return components(links.union(_accepted(overlaps(docs, owners, pairs, n), percent)))


def _skip_blocks(entries: DataFrame, percent: int) -> DataFrame:
    """The entries of list blocks that some block of their list can link to. A block is a band of sizes, so wide that linked
    sets lie in one band or in neighbours; its first position bounds the size of a partner: a set of size n whose first shared
    token stands at p links to sizes up to (100 n - (100 + percent) p) / percent. Blocks are compared, not entries."""
    wide = log(100 / percent) + 1e-9
    entries = entries.withColumn("_band", F.floor(F.log("n") / wide))
    blocks = entries.groupBy("token", "_band").agg(
        F.count("*").alias("_m"), F.min("n").alias("_lo"), (100 * F.max("n") - (100 + percent) * F.min("pos")).alias("_reach"))
    line = W.partitionBy("token").orderBy("_band")

    def meets(size, reach):
        return F.coalesce(reach >= percent * size, F.lit(False))
    inside = (F.col("_m") > 1) & meets(F.col("_lo"), F.col("_reach"))
    below = (F.col("_band") - F.lag("_band").over(line) == 1) & meets(F.col("_lo"), F.lag("_reach").over(line))
    above = (F.lead("_band").over(line) - F.col("_band") == 1) & meets(F.lead("_lo").over(line), F.col("_reach"))
    kept = blocks.withColumn("_kept", inside | F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))).filter("_kept").select("token", "_band")
    return entries.join(kept, ["token", "_band"]).drop("_band")


def _one_list_each(entries: DataFrame) -> DataFrame:
    """Lists that hold the same sets ask the same questions: one of them stays. They are told apart by digests of their sets.
    The one whose token comes first in the global order stays; in each of its sets it stands before the tokens of the others."""
    prints = entries.groupBy("token").agg(
        F.count("*").alias("_m"), F.bit_xor("sid").alias("_x"), F.bit_xor(F.xxhash64("sid")).alias("_y"), F.min("pos").alias("_at"))
    first = prints.filter("_m > 1").groupBy("_m", "_x", "_y").agg(F.min(F.struct("_at", "token"))["token"].alias("token"))
    return entries.join(first.select("token"), "token")


def _accepted(known: DataFrame, percent: int) -> DataFrame:
    return known.filter(linked(F.col("both"), F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def _unsettled(live: DataFrame, roots: DataFrame) -> DataFrame:
    """List entries under their components so far, without the lists that lie in one component."""
    live = live.drop("root").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ends = live.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo != _hi").select("token")
    return materialise(live.join(ends, "token", "left_semi"), "live")


def _pivot_round(docs: DataFrame, owners: DataFrame, heads: DataFrame, live: DataFrame, n: int, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Compare each set with one pivot: the one that most of its lists name. Returns the entries with a mark ``m{k}`` (1 the
    list's pivot or linked to it, 2 too far from it to link to anything linked to it, else 0) and the new links.

    A list's pivot is the set with most copies; after the first round, of the list's smallest component. One comparison a
    set keeps a round linear in the sets, however many lists near copies share.
    """
    tops = live.groupBy("token", "root").agg(F.count("*").alias("_size"), F.max(F.struct("copies", (-F.col("n")).alias("_n"), "sid")).alias("_top"))
    best = F.max("_top") if k == 0 else F.min(F.struct("_size", "_top"))["_top"]
    pivots = tops.groupBy("token").agg(best.alias("_p")).select("token", F.col("_p.sid").alias("b"), (-F.col("_p._n")).alias("b_n"))
    if k:
        pivots = pivots.join(live.select("token", F.col("sid").alias("b"), F.col("root").alias("b_root")), ["token", "b"])
    else:
        pivots = pivots.withColumn("b_root", F.col("b"))
    beside = materialise(live.join(pivots, "token"), "beside")
    near_size = 100 * F.least("n", "b_n") >= (2 * percent - 100) * F.greatest("n", "b_n")
    asked = beside.filter(near_size & (F.col("root") != F.col("b_root"))).groupBy(F.col("sid").alias("a"), "b").agg(
        F.count("*").alias("_lists"), F.first("n").alias("a_n"), F.first("b_n").alias("b_n"))
    pairs = asked.groupBy("a").agg(F.max(F.struct("_lists", "b", "a_n", "b_n")).alias("_p")).select("a", "_p.b", "_p.a_n", "_p.b_n")
    pairs = materialise(pairs, "asked")
    close = materialise(possible(pairs, heads, 2 * percent - 100), "close")
    known = materialise(overlaps(docs, owners, close, n), "known")
    a_n, b_n, both = F.col("a_n"), F.col("b_n"), F.col("both")
    level = F.when(linked(both, a_n, b_n, percent), 1).when(linked(both, a_n, b_n, 2 * percent - 100), 0).otherwise(2)
    marks = pairs.join(known.select("a", "b", level.alias("_level")), ["a", "b"], "left").select(
        F.col("a").alias("sid"), "b", F.coalesce("_level", F.lit(2)).alias("_mark"))
    mark = F.when(F.col("sid") == F.col("b"), 1).when(near_size, F.coalesce("_mark", F.lit(0))).otherwise(2)
    marked = beside.join(marks, ["sid", "b"], "left").withColumn(f"m{k}", mark).drop("b", "b_n", "b_root", "_mark")
    return marked, _accepted(known, percent)


def _open_pairs(live: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (the larger set as a) that no pivot answers: of different components, possible by size, by place and by heads.

    A pair is met at the first token that both sets hold, so it shares no more than either set has from there on; a list that
    is not their first meets them in vain and gives no row. In a link the smaller set's first shared token stands within
    ``(100 - percent) / (100 + percent)`` of its size, so lists are joined with their early entries alone. Entries carry the head's
    bitmap only, as part of the join's condition; whole heads are fetched once for each distinct pair that it leaves."""
    live = live.join(heads.select("sid", F.size("head").alias("size"), *BITMAP), "sid")
    marks = [c for c in live.columns if re.fullmatch(r"m\d+", c)]
    early = live.filter((100 + percent) * F.col("pos") <= (100 - percent) * F.col("n"))
    b = early.select("token", *(F.col(c).alias(f"_{c}") for c in live.columns if c != "token"))
    a_n, b_n = F.col("n"), F.col("_n")
    fits = ((a_n > b_n) | ((a_n == b_n) & (F.col("sid") < F.col("_sid")))) & (F.col("root") != F.col("_root")) & linked(
        F.least(a_n - F.col("pos"), b_n - F.col("_pos")), a_n, b_n, percent)
    for m in marks:
        fits = fits & ~(((F.col(m) == 1) & (F.col(f"_{m}") == 2)) | ((F.col(m) == 2) & (F.col(f"_{m}") == 1)))
    most = at_most_common_bits(a_n, F.col("size"), [F.col(w) for w in BITMAP], b_n, F.col("_size"), [F.col(f"_{w}") for w in BITMAP])
    pairs = live.join(b, "token").filter(fits & linked(most, a_n, b_n, percent)).select(
        F.col("sid").alias("a"), F.col("_sid").alias("b"), F.col("n").alias("a_n"), F.col("_n").alias("b_n")).distinct()
    return possible(materialise(pairs, "met"), heads, percent)


# -- results --------------------------------------------------------------------------------

def keyed(docs: DataFrame) -> DataFrame:
    """doc_id as long (null as the smallest integer), text (null as empty) and a key of the row's text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "row_key", F.xxhash64("text"))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, row_key, n_shingles, component_id (the smallest doc_id that links reach) and component.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct ``n``-word shingles (of the whole
    sequence, if they have fewer words). Null and empty texts have no set and are alone; equal sets are one set with many
    rows; a null doc_id sorts first and comes back as null; repeated rows stay repeated. ``percent`` over 50.
    """
    rows = keyed(docs)
    facts = set_facts(rows, n)
    roots = set_components(rows, facts, n=n, percent=percent)
    own = facts.filter("chunk is null").select("doc_id", "row_key", "n", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    least = own.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, "root", "left")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "row_key", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, real("component_id")).otherwise(real("doc_id")).alias("component_id"), F.col("root").alias("component"))


def first_of_groups(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id, then text key; columns unchanged. Rows
    without words are no duplicates and all stay; of rows equal in doc_id and text one stays."""
    found = near_duplicates(docs, n=n, percent=percent)
    ids = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("row_key").alias("_key"), "component", "n_shingles")
    first = ids.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("_doc", "_key")).alias("_first"))
    kept = first.select("_first._doc", "_first._key", F.lit(False).alias("_empty")).union(
        ids.filter("n_shingles = 0").select("_doc", "_key", F.lit(True)).distinct())
    kept = materialise(kept.toDF("_cl_doc", "_cl_key", "_cl_empty"), "kept")
    rows = docs.withColumn("_cl_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_cl_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    nth = F.row_number().over(W.partitionBy("_cl_doc", "_cl_key").orderBy("_cl_empty"))
    rows = rows.join(kept, ["_cl_doc", "_cl_key"]).withColumn("_cl_nth", nth)
    return rows.filter(F.col("_cl_empty") | (F.col("_cl_nth") == 1)).select(*docs.columns)
