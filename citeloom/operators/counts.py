"""Term, posting and co-occurrence counts over the ``terms(block_ordinal, terms)`` table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.session import MOST_BUCKETS, UNKNOWN_BYTES, materialise, pieces_of, plan_bytes, spread


def postings(terms: DataFrame) -> DataFrame:
    return terms.select("block_ordinal", F.posexplode("terms").alias("position", "anchor")).select(
        "anchor", "block_ordinal", "position")


def anchor_counts(terms: DataFrame) -> DataFrame:
    return (terms.select(F.explode("terms").alias("anchor")).groupBy("anchor")
            .agg(F.count("*").alias("observations")))


def anchor_counts_of_text(docs: DataFrame, text: str = "text", stop=fv.STOP_TERMS) -> DataFrame:
    """Term counts straight from text: count raw words first, normalise each distinct word
    once, then fold the counts together. Same result as counting normalised terms."""
    words = (spread(docs.select(text)).select(F.explode(tx.raw_words(F.col(text))).alias("word")).groupBy("word")
             .agg(F.count("*").alias("n")).filter(~F.col("word").isin(list(stop))))
    return (words.select("n", F.explode(tx.word_anchors(F.col("word"))).alias("anchor")).groupBy("anchor")
            .agg(F.sum("n").alias("observations")))


#: The symbol of ``anchor`` as SQL, so that an index can carry another one in its settings.
SYMBOL = f"concat('0x', upper(substring(sha1(cast(anchor as binary)), 1, {fv.SYMBOL_HEX_CHARS})))"


def lexicon(counts: DataFrame, symbol: str = SYMBOL) -> DataFrame:
    return counts.select("anchor", F.expr(symbol).alias("symbol"), "observations")


def checked_lexicon(counts: DataFrame, symbol: str = SYMBOL) -> DataFrame:
    """The written lexicon; an error if two anchors share a symbol. Collisions are observed in the pass that writes: a
    symbol's group keeps two anchors and a count, however many share it."""
    seen = Observation()
    groups = lexicon(counts, symbol).groupBy("symbol").agg(
        F.min("anchor").alias("anchor"), F.max("anchor").alias("last_anchor"), F.max("observations").alias("observations"), F.count("*").alias("anchors"))
    shared = F.when(F.col("anchors") > 1, F.struct("symbol", "anchor", "last_anchor"))
    watched = groups.observe(seen, F.count_if(F.col("anchors") > 1).alias("collisions"), F.max(F.to_json(shared)).alias("example"))
    written = materialise(watched.select("anchor", "symbol", "observations"), "lexicon")
    if seen.get["collisions"]:
        raise ValueError(f"symbol collision: {seen.get['collisions']} symbols stand for several anchors, such as {seen.get['example']}")
    return written


def symbol_collisions(lex: DataFrame) -> DataFrame:
    """Symbols that stand for more than one anchor. The collected anchors are as many as
    collide on 48 hash bits."""
    return (lex.groupBy("symbol").agg(F.count("*").alias("anchors"), F.min("anchor").alias("first_anchor"),
                                      F.max("anchor").alias("last_anchor"))
            .filter(F.col("anchors") > 1))


def assert_no_collisions(lex: DataFrame) -> None:
    row = symbol_collisions(lex).head()
    if row is not None:
        raise ValueError(f"symbol collision: {row.first_anchor!r} and {row.last_anchor!r} share {row.symbol}")


def forward_pairs(terms: Column, window: int = fv.RELATION_WINDOW) -> Column:
    """(anchor, later anchor, offset 1..window) for one block, as an array of structs."""
    n = F.size(terms)
    def at(offset: int) -> Column:
        keep = F.greatest(n - offset, F.lit(0))
        return F.zip_with(F.slice(terms, F.lit(1), keep), F.slice(terms, F.lit(1 + offset), keep),
                          lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.lit(offset).alias("o")))
    return F.flatten(F.array(*[at(offset) for offset in range(1, window + 1)]))


def relation_counts(terms: DataFrame, window: int = fv.RELATION_WINDOW) -> DataFrame:
    """Directed neighbour counts. The relation is symmetric, count(a, b, o) = count(b, a, -o),
    so only later neighbours are generated and counted; the other half is mirrored after the
    aggregation. That halves the rows that are exploded and shuffled."""
    return mirror(later_relations(terms, window))


#: Bytes of a compressed table whose pairs one task merges, terms that stand for as much, terms whose pairs are counted at once.
PART_BYTES, PART_TERMS, CHUNK_TERMS = 8 << 20, 1 << 21, 1 << 20
#: Bits of the map that tells tasks which terms are asked, where they are too many to be named.
ASKED_BITS = 1 << 24
COUNTED = "part int, words array<string>, a array<int>, b array<int>, o array<tinyint>, n array<int>"


def merge_parts(terms: DataFrame, times: int = 1) -> int:
    """How many tasks merge the pairs of a table, each of ``times`` parts' bytes."""
    least = terms.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(terms) < UNKNOWN_BYTES:
        return pieces_of(terms, times * PART_BYTES, least, MOST_BUCKETS)
    return min(MOST_BUCKETS, max(least, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // (times * PART_TERMS))))


def dealt_pairs(terms: DataFrame, parts: int, window: int, **kind) -> DataFrame:
    """The counted pairs of all chunks, dealt to their parts."""
    return terms.select("terms").mapInArrow(chunk_counter(window, parts, CHUNK_TERMS, **kind), COUNTED).repartitionById(parts, "part")


def later_relations(terms: DataFrame, window: int = fv.RELATION_WINDOW) -> DataFrame:
    """The half of the relations with later neighbours: (a, b, o, observations). Each task counts the pairs of a chunk of terms
    by number and deals them by their two terms, so a hot term's pairs lie in every part; a part's rows are added up."""
    return dealt_pairs(terms, merge_parts(terms), window).mapInArrow(part_merger(), "a string, b string, o int, observations bigint")


def asked_pairs(terms: DataFrame, asked: pa.Array, window: int = fv.RELATION_WINDOW, *, offsets: bool = True, near: pa.Array | None = None,
                drop: pa.Array | None = None, first: int | None = None) -> DataFrame:
    """(anchor, neighbor, offset, observations) of the named anchors alone, offset 0 for all together without ``offsets``; ``near``
    names the neighbours that count, ``drop`` those that do not. Pairs are dealt by their neighbour: a hot one meets no more
    than the asked anchors. A pair lies in one part, so with ``first`` a part keeps the first entries of each anchor (and offset)
    by observations, neighbour, offset; those of the whole are among them."""
    deal = {"asked": asked, "near": near, "drop": drop, "offsets": offsets, "directed": True}
    return dealt_pairs(terms, merge_parts(terms, 2), window, **deal).mapInArrow(
        part_merger(pick=list_fronts(first=first, by_offset=offsets)), "anchor string, neighbor string, offset int, observations bigint")


def asked_totals(terms: DataFrame, asked: DataFrame, window: int = fv.RELATION_WINDOW, *, first: int | None = None) -> DataFrame:
    """(anchor, neighbor, observations) over all offsets of any number of asked anchors; ``first`` as in ``asked_pairs``. Tasks know
    the anchors by a bitmap of fixed size; what it lets through in error goes in the join."""
    bits = asked_bits(asked, ASKED_BITS)
    rows = dealt_pairs(terms, merge_parts(terms), window, asked=bits, offsets=False).mapInArrow(
        part_merger(pick=list_fronts(asked=bits, first=first, mirrored=True)), "anchor string, neighbor string, offset int, observations bigint")
    return rows.drop("offset").join(asked.select("anchor").distinct(), "anchor", "left_semi")


def asked_bits(asked: DataFrame, bits: int) -> bytes:
    """Bitmap of the anchors' checksums: a few maps of fixed size reach the driver, whatever the number of anchors."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits >> 3, "uint8")
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype("uint8"))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bits"])

    at = asked.filter(F.col("anchor").isNotNull()).select((F.crc32(F.col("anchor").cast("binary")) % bits).alias("at"))
    maps = [np.frombuffer(r[0], "uint8") for r in at.coalesce(8).mapInArrow(mapped, "bits binary").collect()]
    return np.bitwise_or.reduce([np.zeros(bits >> 3, "uint8"), *maps]).tobytes()


# A pair is one number: the places of its terms in a list of words (28 bits each) and the offset (7 bits). Between tasks the three
# stand apart, in order, as short columns that compress. The functions below hold all they need: executors need no copy of the package.

def among(asked: pa.Array | bytes | None, none: bool = True) -> Callable[[pa.Array], np.ndarray]:
    """Which words are among the asked ones: named, or marked in a bitmap by checksum; ``none`` for all where none are given."""
    def held(words: pa.Array) -> np.ndarray:
        if asked is None:
            return np.full(len(words), none)
        if isinstance(asked, bytes):
            bits = np.frombuffer(asked, "uint8")
            at = np.array([crc32((w or "").encode()) for w in words.to_pylist()], "int64") % (len(bits) << 3)
            return (bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return pc.is_in(words, value_set=asked).to_numpy(zero_copy_only=False)
    return held


def chunk_counter(window: int, parts: int, chunk: int, *, asked: pa.Array | bytes | None = None, near: pa.Array | None = None,
                  drop: pa.Array | None = None, offsets: bool = True, directed: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the pairs that start in a chunk of terms, one row for each part they fall into, with the part's words. Pairs
    without an ``asked`` term are left out. A pair stands once, by its later neighbour, or without ``offsets`` by the lesser
    term; ``directed`` gives it from each asked term to a term of ``near`` that is not in ``drop``, with a signed offset."""
    if not 0 <= window < (64 if directed else 128):
        raise ValueError("window must be below 64 where offsets are signed, else below 128")
    is_asked, is_near, is_dropped = among(asked), among(near), among(drop, False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            row = np.repeat(np.arange(len(lists), dtype="int32"), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            for start in range(0, len(flat), chunk):
                met = flat.slice(start, chunk + window).dictionary_encode(null_encoding="encode")
                words = met.dictionary.cast(pa.string())
                code, at = met.indices.to_numpy().astype("int64"), row[start:start + chunk + window]
                if not offsets and not directed:  # numbered in order, the lesser term stands first in every chunk
                    order = pc.sort_indices(words).to_numpy()
                    place = np.empty(len(order), "int64")
                    place[order] = np.arange(len(order))
                    words, code = words.take(pa.array(order)), place[code]
                wanted = is_asked(words)
                other = is_near(words) & ~is_dropped(words)
                found = []
                for offset in range(1, window + 1):
                    first = max(0, min(chunk, len(code) - offset))  # pairs that start behind the chunk belong to the next
                    same = at[:first] == at[offset:offset + first]
                    x, y = code[:first], code[offset:offset + first]
                    if directed:
                        there, back = same & wanted[x] & other[y], same & wanted[y] & other[x]
                        found.append(x[there] << 35 | y[there] << 7 | (offset if offsets else 0))
                        found.append(y[back] << 35 | x[back] << 7 | (-offset & 127 if offsets else 0))
                    else:
                        same &= wanted[x] | wanted[y]
                        x, y = x[same], y[same]
                        found.append(x << 35 | y << 7 | offset if offsets else np.minimum(x, y) << 35 | np.maximum(x, y) << 7)
                met = code = same = x = y = None  # the largest arrays that wait for each other decide a task's memory
                pair = np.concatenate(found or [at[:0].astype("int64")])
                found = None
                if not len(pair):
                    continue
                pair.sort()
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                n = np.diff(first, append=len(pair)).astype("int32")
                pair = pair[first]
                first = None
                mark = np.array([crc32((w or "").encode()) for w in words.to_pylist()], "int64")
                a, b, offset = (pair >> 35).astype("int32"), (pair >> 7 & 0xFFFFFFF).astype("int32"), (pair & 127).astype("int8")
                pair = None
                # both directions of a pair lie in one part
                by = mark[b] if directed else np.minimum(mark[a], mark[b]) * 31 + np.maximum(mark[a], mark[b])
                part = (by % 1000003 % parts).astype("uint16")  # MOST_BUCKETS at most
                order = np.argsort(part, kind="stable")
                by, part, a, b, offset, n = None, part[order], a[order], b[order], offset[order], n[order]
                order = None
                ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
                held, sizes, place = [], [], np.zeros(len(words), "int32")
                for s, e in zip(np.concatenate(([0], ends[:-1])), ends):
                    own = np.unique(np.concatenate((a[s:e], b[s:e])))
                    place[own] = np.arange(len(own))
                    held.append(own)
                    sizes.append(len(own))
                    a[s:e], b[s:e] = place[a[s:e]], place[b[s:e]]
                cuts = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                column = lambda values, kind: pa.ListArray.from_arrays(cuts(np.diff(ends, prepend=0)), pa.array(values.astype(kind)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[ends - 1], pa.int32()), pa.ListArray.from_arrays(cuts(sizes), words.take(pa.array(np.concatenate(held)))),
                    column(a, "int32"), column(b, "int32"), column(offset, "int8"), column(n, "int32")], ["part", "words", "a", "b", "o", "n"])
    return count


def part_adder(most: int) -> Callable[[Iterator[pa.RecordBatch]], tuple | None]:
    """Words, pairs in order and sums of a part's counts. They are added up whenever ``most`` pairs wait, so a task holds its
    distinct pairs and those."""
    def added(held: list) -> tuple:
        words = pa.concat_arrays([h[0] for h in held]).dictionary_encode(null_encoding="encode")
        code = words.indices.to_numpy().astype("int64")
        if len(words.dictionary) >> 28:
            raise ValueError("too many words in one part of the relations")
        pair, n, at, start = np.empty(sum(len(h[1]) for h in held), "int64"), np.concatenate([h[2] for h in held]), 0, 0
        for own, numbers, _ in held:
            pair[at:at + len(numbers)] = code[start + (numbers >> 35)] << 35 | code[start + (numbers >> 7 & 0xFFFFFFF)] << 7 | numbers & 127
            at, start = at + len(numbers), start + len(own)
        held.clear()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        order = None
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return words.dictionary, pair[first], np.add.reduceat(n, first, dtype="int64")

    def add(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        held, waiting = [], 0
        for batch in batches:
            words = batch.column(1)
            a, b, offset = (batch.column(i).flatten().to_numpy().astype("int64") for i in (2, 3, 4))
            n = batch.column(5).flatten().to_numpy()
            sizes, starts = batch.column(2).value_lengths().to_numpy(), np.cumsum(words.value_lengths().to_numpy()) - words.value_lengths().to_numpy()
            if len(words.flatten()) >> 28:
                raise ValueError("too many words in one batch of the relations")
            # places count within a row's words: moved to the batch's
            move = np.repeat(starts, sizes).astype("int64")
            held.append((words.flatten(), a + move << 35 | b + move << 7 | offset, n))
            waiting += len(n)
            if waiting >= most:
                held, waiting = [added(held)], 0
        return added(held) if held else None
    return add


def part_merger(most: int = 1 << 22, rows: int = 1 << 16, pick: Callable[..., tuple] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a part's counts as rows; ``pick`` may turn (words, a, b, o, n) into other rows of the same kind."""
    names = ["anchor", "neighbor", "offset", "observations"] if pick else ["a", "b", "o", "observations"]
    add = part_adder(most)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = add(batches)
        if got is None:
            return
        words, pair, n = got
        a, b, o = pair >> 35, pair >> 7 & 0xFFFFFFF, pair & 127
        if pick:
            a, b, o, n = pick(words, a, b, o, n)
        for s in range(0, len(a), rows):
            yield pa.RecordBatch.from_arrays([
                words.take(pa.array(a[s:s + rows])), words.take(pa.array(b[s:s + rows])), pa.array(o[s:s + rows], pa.int32()),
                pa.array(n[s:s + rows], pa.int64())], names)
    return merge


def list_fronts(asked: bytes | None = None, first: int | None = None, by_offset: bool = False, mirrored: bool = False) -> Callable[..., tuple]:
    """Directed rows of the ``asked`` anchors, with ``first`` the first of each anchor (``by_offset``: and offset) in a part.
    ``mirrored`` takes totals that stand once: a term's own repeats count from each side."""
    is_asked = among(asked)

    def pick(words: pa.Array, a: np.ndarray, b: np.ndarray, o: np.ndarray, n: np.ndarray) -> tuple:
        if mirrored:
            own, two = a == b, a != b
            a, b, o, n = np.concatenate((a, b[two])), np.concatenate((b, a[two])), np.zeros(len(a) + two.sum(), "int64"), np.concatenate((n << own, n[two]))
            kept = is_asked(words)[a]
            a, b, o, n = a[kept], b[kept], o[kept], n[kept]
        else:
            o = (o ^ 64) - 64
        if first is not None:
            place = np.empty(len(words), "int64")
            place[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            group = a << 7 | (o + 64 if by_offset else 0)
            order = np.lexsort((o, place[b], -n, group))
            start = np.flatnonzero(np.diff(group[order], prepend=-1))
            at = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
            order = order[at < first]
            a, b, o, n = a[order], b[order], o[order], n[order]
        return a, b, o, n
    return pick


def part_sizes(most: int = 1 << 22) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A part's numbers of relations and of pairs, both directions counted; no pair leaves the task."""
    add = part_adder(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = add(batches)
        if got is not None:
            a, b = got[1] >> 35, got[1] >> 7 & 0xFFFFFFF
            once = np.unique(np.minimum(a, b) << 28 | np.maximum(a, b))
            pairs = 2 * len(once) - np.count_nonzero(once >> 28 == once & 0xFFFFFFF)
            yield pa.RecordBatch.from_pydict({"relations": pa.array([2 * len(got[1])], pa.int64()), "pairs": pa.array([pairs], pa.int64())})
    return count


def mirror(ahead: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("anchor"), F.col("b").alias("neighbor"), F.col("o").alias("offset")),
                   F.struct(F.col("b").alias("anchor"), F.col("a").alias("neighbor"), (-F.col("o")).alias("offset")))
    return ahead.select(F.explode(both).alias("r"), "observations").select("r.*", "observations")


def relation_sizes(terms: DataFrame, window: int = fv.RELATION_WINDOW) -> DataFrame:
    """Row counts of ``relation_counts`` and ``pair_totals``, one row (relations, pairs): pairs are counted by number and leave
    their part as two sums."""
    sizes = dealt_pairs(terms, merge_parts(terms), window).mapInArrow(part_sizes(), "relations bigint, pairs bigint")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return sizes.agg(n("relations"), n("pairs"))


def mirrored_totals(once: DataFrame) -> DataFrame:
    """(anchor, neighbor, observations) in both directions; a term's own repeats count once from each side."""
    row = lambda x, y, n: F.struct(F.col(x).alias("anchor"), F.col(y).alias("neighbor"), n.alias("observations"))
    both = F.when(F.col("a") == F.col("b"), F.array(row("a", "b", F.col("n") * 2))).otherwise(
        F.array(row("a", "b", F.col("n")), row("b", "a", F.col("n"))))
    return once.select(F.explode(both).alias("r")).select("r.*")


def pair_totals(relations: DataFrame, counts: DataFrame) -> DataFrame:
    """Neighbour totals over all offsets, with the neighbour's own observations beside them
    (2·window times those bound any total the neighbour can reach). Totals are symmetric, so
    only later neighbours are summed, under one key for both directions, and then mirrored."""
    a, b = F.least("anchor", "neighbor").alias("a"), F.greatest("anchor", "neighbor").alias("b")
    once = relations.filter(F.col("offset") > 0).groupBy(a, b).agg(F.sum("observations").alias("n"))
    own = counts.select(F.col("anchor").alias("neighbor"), F.col("observations").alias("neighbor_observations"))
    return mirrored_totals(once).join(own, "neighbor").select(
        "anchor", "neighbor", "observations", "neighbor_observations")


def relation_total(n: Column, window: int = fv.RELATION_WINDOW) -> Column:
    """Closed-form number of relation observations of a block with ``n`` anchors."""
    short = F.least(n, F.lit(window)).cast("bigint")
    full = F.greatest(n - window, F.lit(0)).cast("bigint")
    # the short ramp at a block's start plus full windows; the other side is alike
    return short * (short - 1) + 2 * window * full


def merge_counts(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts are additive over files: union the parts and sum."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.sum("observations").alias("observations"))
