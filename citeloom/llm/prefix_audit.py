"""Source divergence audit: which sources of a language write unlike each other, and by which terms.

Terms that too few documents hold are never counted in full: an iceberg search walks down byte prefixes. Texts become blocks
once (sorted distinct terms, and each document's terms with their counts). Level by level (4, 8, 16, ... bytes) the tasks count
the distinct documents of every prefix whose shorter prefix survived, Spark adds the counts up and discards prefixes below the
threshold; a term's last prefix ends with a zero byte, so it is complete, and the walk ends when no open prefix is left. Tasks
learn the survivors from a bitmap of hashes of fixed size; a wrong hit only lets a prefix be counted once more before it goes,
and the kept terms are joined by name, so the result is exact at every size. A hot language or source is summed inside tasks.

Null text, lang and source count as ''. Repeated rows count as often as they stand. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.tasks import map_arrow
from citeloom.llm.words import Interned, pieces, utf8
from citeloom.session import at_most, broadcast_if, materialise, new_location

MIN_DOCS = 10
TOP_TERMS = 10
FIRST_LENGTH = 4
BITMAP_BITS = 26
BLOCK_BYTES = 12 << 20
WIDE_PREFIX = 256
SMALL_GROUPS = 100_000
#: A-Z lower-cased, letters and all bytes of characters beyond ASCII as they are, everything else white space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_SCHEMA = "lang string, longest int, sources array<string>, terms binary, doc_source binary, doc_terms binary, term binary, n binary"


# -- blocks -------------------------------------------------------------------------------

def term_blocks(docs: DataFrame) -> DataFrame:
    """Written table: per block of documents of one language its sorted terms (joined by zero bytes), and as int32: each
    document's source and number of distinct terms, then all these terms by place and their counts."""
    rows = docs.select(F.col("text").cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BLOCK_BYTES):
            texts, sources = utf8(batch.column("text")), batch.column("source").to_pylist()
            by_lang: dict[str, list[int]] = defaultdict(list)
            for at, lang in enumerate(batch.column("lang").to_pylist()):
                by_lang[lang].append(at)
            for lang, at in by_lang.items():
                words = Interned(texts[i].translate(LETTERS).split() for i in at)
                vocab = words.vocab
                order = sorted(range(len(vocab)), key=vocab.__getitem__)
                place = np.zeros(len(vocab), np.int64)
                place[order] = np.arange(len(vocab))
                key, n = np.unique(words.rows * max(1, len(vocab)) + place[words.ids], return_counts=True)
                doc, term = np.divmod(key, max(1, len(vocab)))
                names: dict[str, int] = {}
                own = [names.setdefault(sources[i], len(names)) for i in at]
                data = (b"\0".join(vocab[i] for i in order), own, np.bincount(doc, minlength=len(at)), term, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang]), pa.array([max(map(len, vocab), default=0)], pa.int32()), pa.array([list(names)], pa.list_(pa.string())),
                    pa.array([data[0]], pa.binary()), *(pa.array([np.asarray(x, "<i4").tobytes()], pa.binary()) for x in data[1:])], names=columns)

    columns = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    folder = new_location(docs.sparkSession, "term-blocks")
    map_arrow(rows, run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(folder)


def terms_of(joined: bytes) -> list[bytes]:
    return joined.split(b"\0") if joined else []


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4")


# -- the bitmap of survivors --------------------------------------------------------------

def hashes(lang: str, prefixes: list[bytes]) -> np.ndarray:
    """The same 64-bit hash that Spark's ``xxhash64`` gives for language, zero byte, prefix."""
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + p, 42) for p in prefixes), np.uint64, len(prefixes))


def bitmap_of(survivors: DataFrame, bits: int, name: str = "prefix") -> np.ndarray:
    """Bitmap over the last ``bits`` bits of all survivors' hashes; it is summed up in Spark, so at most 2^bits / 64 rows reach
    the driver."""
    h = F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col(name))).bitwiseAND((1 << bits) - 1)
    rows = survivors.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("set")).toPandas()
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).view(np.uint64)
    return out


def holds(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    h = h & np.uint64((1 << bits) - 1)
    return (bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


# -- refinement ---------------------------------------------------------------------------

def prefixes_of(terms: list[bytes], length: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct prefixes of sorted terms with their end marks, and the number of each term's prefix. A term shorter than
    ``length`` is complete, so its prefix ends with the mark."""
    if length <= WIDE_PREFIX:
        cut = np.array(terms, f"S{length}")
        new = np.r_[True, cut[1:] != cut[:-1]]
        names = cut[new].tolist()
    else:
        cut = [t[:length] for t in terms]
        new = np.array([True, *(x != y for x, y in zip(cut[1:], cut))])
        names = [cut[i] for i in np.flatnonzero(new)]
    return [p if len(p) == length else p + b"\0" for p in names], np.cumsum(new) - 1


def open_terms(lang: str, terms: list[bytes], before: int, survivors: np.ndarray, bits: int) -> np.ndarray:
    """Places of terms that go beyond ``before`` bytes and whose first ``before`` bytes survived."""
    at = np.array([i for i, t in enumerate(terms) if len(t) >= before], np.int64)
    if not before or not len(at):
        return at
    heads, group = prefixes_of([terms[i] for i in at], before)
    return at[holds(survivors, hashes(lang, heads), bits)[group]]


def prefix_documents(blocks: DataFrame, length: int, before: int, survivors: np.ndarray | None, bits: int) -> DataFrame:
    """(lang, prefix, docs): distinct documents of each prefix of ``length`` bytes below a surviving one of ``before`` bytes."""
    sent = blocks.sparkSession.sparkContext.broadcast(survivors)  # 2^bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, joined, lens, term in zip(*(batch.column(c).to_pylist() for c in ("lang", "terms", "doc_terms", "term")), strict=True):
                terms = terms_of(joined)
                at = open_terms(lang, terms, before, sent.value, bits)
                if not len(at):
                    continue
                prefixes, number = prefixes_of([terms[i] for i in at], length)
                group = np.full(len(terms), -1, np.int32)  # terms are sorted, so prefixes are numbered in order
                group[at] = number
                own, lens = group[numbers(term)], numbers(lens)
                doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[own >= 0]
                own = own[own >= 0]
                new = np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]
                n = np.bincount(own[new], minlength=len(prefixes))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(prefixes, pa.binary()), pa.array(n)], names=["lang", "prefix", "docs"])

    rows = map_arrow(blocks.filter(F.col("longest") >= before).select("lang", "terms", "doc_terms", "term"), run, "lang string, prefix binary, docs long")
    return rows.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))


def kept_terms(blocks: DataFrame, *, min_docs: int = MIN_DOCS, first_length: int = FIRST_LENGTH, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, term, docs) of every term that at least ``min_docs`` documents of its language hold; term is binary."""
    found: list[DataFrame] = []
    before, length, survivors = 0, first_length, None
    while True:
        level = materialise(prefix_documents(blocks, length, before, survivors, bits).filter(F.col("docs") >= min_docs)
                            .withColumn("complete", F.substring("prefix", -1, 1) == F.lit(b"\0")), f"prefixes-{length}")
        found.append(level.filter("complete").select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("term"), "docs"))
        survivors = bitmap_of(level.filter("not complete"), bits)
        if not survivors.any():
            break
        before, length = length, 2 * length
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def term_counts(blocks: DataFrame, kept: DataFrame, *, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, source, term, n): occurrences of kept terms, where there are any. A block sends one row per term with its
    sources beside it; what one exchange by (lang, term) brings together is counted by source there."""
    sent = blocks.sparkSession.sparkContext.broadcast(bitmap_of(kept, bits, "term"))  # 2^bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, joined, *data in zip(*(batch.column(c).to_pylist() for c in ("lang", "sources", "terms", "doc_source", "doc_terms", "term", "n")), strict=True):
                terms = terms_of(joined)
                doc_source, lens, term, n = map(numbers, data)
                if not len(term):
                    continue
                mine = holds(sent.value, hashes(lang, terms), bits)[term]
                key = term[mine] * np.int64(len(sources)) + np.repeat(doc_source, lens)[mine]
                order = np.argsort(key, kind="stable")
                key, first = np.unique(key[order], return_index=True)
                if not len(key):
                    continue
                total = np.add.reduceat(n[mine][order].astype(np.int64), first)
                at, source = np.divmod(key, len(sources))
                begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                offsets = pa.array(np.r_[begin, len(key)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(begin), pa.string()), pa.array([terms[i] for i in at[begin]], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string()).take(pa.array(source))), pa.ListArray.from_arrays(offsets, pa.array(total))],
                    names=["lang", "term", "sources", "counts"])

    rows = map_arrow(blocks.drop("longest"), run, "lang string, term binary, sources array<string>, counts array<long>")
    rows = rows.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    return rows.groupBy("lang", "term", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))


# -- divergence ---------------------------------------------------------------------------

def share(n: Column | str, total: str, v: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exact for any counts."""
    top = (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)") + F.lit(2).cast("decimal(2,0)")
    bottom = F.col(total).cast("decimal(20,0)") + F.col(v).cast("decimal(19,0)") * F.lit(2).cast("decimal(1,0)")
    scaled = top * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(F.col(v) > 0, F.call_function("div", scaled, bottom) + 1)


def distance(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so all fits a long."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: every other source of the language by the distance summed
    over all kept terms. Part ``term``: the ``top`` kept terms that the source uses more than its language does.

    A pair's sum over all kept terms is taken from what occurs: the distance of two absent terms times their number, corrected
    by the terms of each source (a histogram of counts is enough) and by the terms that both hold.
    """
    blocks = term_blocks(docs)
    kept = materialise(kept_terms(blocks, min_docs=min_docs, bits=bits), "kept-terms")
    counts = materialise(term_counts(blocks, kept, bits=bits), "term-counts")
    groups = blocks.select("lang", F.explode("sources").alias("source")).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = materialise(groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").join(langs, "lang", "left")
                         .na.fill(0).withColumn("none", share(F.lit(0), "total", "v")), "groups")
    small = at_most(groups, SMALL_GROUPS)
    rows = materialise(counts.join(broadcast_if(groups, small), ["lang", "source"]).withColumn("p", share("n", "total", "v")), "shares")

    used = rows.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    terms = rows.join(used, ["lang", "term"]).withColumn("q", share("lang_n", "lang_total", "v")).filter("p > q")
    terms = ranked(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), distance("p", "q").alias("value"))).filter(F.col("rank") <= top)

    a = groups.select("lang", "source", "v", "none")
    b = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    pairs = a.join(broadcast_if(b, small), "lang").filter("source != item")
    base = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * distance("none", "item_none")).otherwise(0).alias("value"))
    histogram = rows.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("terms"))
    alone = histogram.join(broadcast_if(b, small), "lang").filter("source != item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (distance("p", "item_none") - distance("none", "item_none"))).alias("value"))
    x = rows.select("lang", "term", "source", "p", "none")
    y = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("item_none"))
    both = x.join(y, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(
        distance("p", "q") - distance("p", "item_none") - distance("none", "q") + distance("none", "item_none")).alias("value"))
    turned = [s.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for s in (alone, both)]
    summed = base.unionByName(alone).unionByName(both).unionByName(turned[0]).unionByName(turned[1])
    summed = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")).unionByName(terms)


def ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
