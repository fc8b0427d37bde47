"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact sequence likelihood by scaled forward recursion.

The states emit symbols: each of the most frequent training words is a symbol, all other words share symbols by their first
letters, and the end of a text is one. A shared symbol's word is drawn by its smoothed training count, so the model gives
every word sequence a probability while its parameters keep a fixed size. Counts of words are exact over all documents; a
word meets its count in a shuffled join, never in a broadcast vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tasks import group_arrow, map_arrow, ship
from citeloom.llm.words import Interned, lower_words, pieces, utf8
from citeloom.session import materialise

STATES = 8
#: Words with a symbol of their own, and symbols that the other words share.
FREQUENT = 8192
SHARED = 4096
SYMBOLS = FREQUENT + SHARED + 1
END = SYMBOLS - 1
PASSES = 3
#: The start of training is fitted on so many tokens at most; every pass after it reads all training documents.
START_TOKENS = 400_000
START_PASSES = 12
#: Tokens of a block of documents that share one vocabulary, and of a batch of the recursion.
BLOCK_TOKENS = 6_000_000
BATCH_TOKENS = 400_000
SLICES = 32


# -- the model ------------------------------------------------------------------------------

@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states, states
    emit: np.ndarray  # symbols, states

    def forward(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables and scales; ``sym`` is (steps, texts), texts sorted by falling length."""
        alpha, scale = np.zeros((*sym.shape, len(self.start))), np.ones(sym.shape)
        live = np.searchsorted(-lens, -np.arange(1, len(sym) + 1), side="right")
        now = np.broadcast_to(self.start, (sym.shape[1], len(self.start)))
        for t, n in enumerate(live.tolist()):
            now = (now[:n] if t == 0 else now[:n] @ self.move) * self.emit[sym[t, :n]]
            s = now.sum(1)
            now = now / s[:, None]
            alpha[t, :n], scale[t, :n] = now, s
        return alpha, scale

    def counts(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of a batch (the Baum-Welch step)."""
        alpha, scale = self.forward(sym, lens)
        k = len(self.start)
        moves, gamma = np.zeros((k, k)), alpha
        beta = np.ones((sym.shape[1], k))
        for t in range(len(sym) - 1, 0, -1):
            n = int(np.searchsorted(-lens, -(t + 1), side="right"))
            ahead = self.emit[sym[t, :n]] * beta[:n] / scale[t, :n, None]
            moves += alpha[t - 1, :n].T @ ahead
            gamma[t, :n] *= beta[:n]
            beta[:n] = ahead @ self.move.T
        gamma[0] *= beta
        real = np.arange(len(sym))[:, None] < lens[None, :]
        flat, g = sym[real], gamma[real]
        emit = np.stack([np.bincount(flat, g[:, i], SYMBOLS) for i in range(k)], axis=1)
        return gamma[0].sum(0), moves * self.move, emit

    @staticmethod
    def of(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, base: np.ndarray) -> "Model":
        """Parameters from counts, smoothed so that nothing is impossible; ``base`` is the symbols' overall distribution."""
        emit = emit + 50.0 * base[:, None]
        start, moves = start + 0.5, moves + 0.5
        return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def batches_of(symbols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, symbols by step and text) of batches of about BATCH_TOKENS, longest texts first."""
    order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
    at = 0
    while at < len(order):
        width = max(1, BATCH_TOKENS // max(1, len(symbols[order[at]])))
        rows = np.array(order[at:at + width])
        lens = np.array([len(symbols[i]) for i in rows])
        grid = np.zeros((lens[0], len(rows)), np.int64)
        for c, i in enumerate(rows):
            grid[:lens[c], c] = symbols[i]
        yield rows, lens, grid
        at += width


def first_model(symbols: list[np.ndarray], base: np.ndarray, states: int) -> Model:
    """Baum-Welch on a bounded sample from a start that is fixed by seed: states lean to different symbols."""
    rng = np.random.default_rng(11)
    model = Model.of(np.ones(states), np.ones((states, states)) + 20 * np.eye(states), 1e4 * base[:, None] * rng.gamma(1.0, size=(SYMBOLS, states)), base)
    for _ in range(START_PASSES if symbols else 0):
        model = Model.of(*map(sum, zip(*(model.counts(grid, lens) for _, lens, grid in batches_of(symbols)))), base)
    return model


# -- words, counts and symbols -----------------------------------------------------------------

BLOCKS = "block long, docs array<long>, held array<boolean>, lens array<long>, ids binary, vocab binary, shares binary, counts binary"
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest double, symbols binary"


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def word_blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: word ids into the block's own vocabulary, and that vocabulary with its training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, it = TaskContext.get().partitionId(), 0, [], Interned()

        def flush() -> pa.RecordBatch:
            train = np.repeat(np.array([not h for _, h in held]), it.lens)
            words = it.vocab
            vocab = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            shares = np.fromiter((xxhash.xxh3_64_intdigest(w[:3]) % SHARED for w in words), np.uint16, len(words))
            counts = np.bincount(it.ids[train], minlength=len(vocab)).astype(np.uint32)
            columns = ([part << 32 | nth], [[d for d, _ in held]], [[h for _, h in held]], [it.lens.tolist()],
                       *([pack(x)] for x in (it.ids.astype(np.uint32), vocab, shares, counts)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        size = 0
        for batch in pieces(batches, "text"):
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), utf8(batch.column("text"))):
                held.append((doc, out))
                it.add(lower_words(text))
                size += len(it.flat[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
                    nth, held, it, size = nth + 1, [], Interned(), 0
        if held:
            yield flush()

    return materialise(map_arrow(docs.select("doc_id", "held", "text"), run, BLOCKS), "word_blocks")


def block_words(blocks: DataFrame) -> DataFrame:
    """(word, share, n, block, at): a row for each word of each block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v, s, c in zip(*(batch.column(x).to_pylist() for x in ("block", "vocab", "shares", "counts"))):
                vocab, share, count = unpack(v, np.int64), unpack(s, np.uint16).astype(np.int32), unpack(c, np.uint32).astype(np.int64)
                for a in range(0, len(vocab), 100_000):
                    e = min(len(vocab), a + 100_000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(vocab[a:e]), pa.array(share[a:e]), pa.array(count[a:e]), pa.array(np.full(e - a, block)),
                        pa.array(np.arange(a, e, dtype=np.int32))], names=["word", "share", "n", "block", "at"])

    return map_arrow(blocks.select("block", "vocab", "shares", "counts"), run, "word long, share int, n long, block long, at int")


@dataclass
class Totals:
    """What all documents are scored with: sizes of the training corpus, frequent words, counts of symbols."""

    tokens: int
    distinct: int
    frequent: np.ndarray  # word hashes by rank
    share_count: np.ndarray
    share_words: np.ndarray
    base: np.ndarray

    def rank_of(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each frequent word, -1 for the others."""
        if not len(self.frequent):
            return np.full(len(words), -1)
        order = np.argsort(self.frequent)
        at = np.searchsorted(self.frequent, words, sorter=order)
        found = order[np.minimum(at, len(order) - 1)]
        return np.where(self.frequent[found] == words, found, -1)


def corpus_totals(counts: DataFrame, texts: int) -> Totals:
    """``counts``: (word, share, n) of the training words; ``texts`` training documents. Collects the frequent words and a row
    for each shared symbol, both of fixed number."""
    whole = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "n", "share").collect()
    shares = counts.groupBy("share").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    count, words = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in shares:
        count[r["share"]], words[r["share"]] = r["n"], r["v"]
    for r in top:
        count[r["share"]] -= r["n"]
        words[r["share"]] -= 1
    base = np.zeros(SYMBOLS)
    base[:len(top)], base[FREQUENT:END], base[END] = [r["n"] for r in top], count, texts
    base = (base + 0.1) / (base + 0.1).sum()
    return Totals((whole[0] or 0) + texts, whole[1] + (texts > 0), np.array([r["word"] for r in top], np.int64), count, words, base)


def code_documents(blocks: DataFrame, found: DataFrame, totals: Totals, texts: int) -> DataFrame:
    """One row per document: its symbols, its base score, and the log10 probability of its words given their symbols.
    ``found``: (block, at, n) with the corpus count of every word of every block."""
    held = blocks.sparkSession.sparkContext.broadcast(totals)

    def counted(table):
        at, n = table.column("at").to_numpy(), table.column("n").to_numpy()
        out = np.zeros(len(at), np.int64)
        out[at] = n
        return pa.table({"block": table.column("block")[:1], "corpus": pa.array([pack(out)], pa.binary())})

    def code(left, right):
        t = held.value
        rows = []
        for r in left.to_pylist():
            c = unpack(right.column("corpus")[0].as_py(), np.int64) if right.num_rows else np.zeros(0, np.int64)
            vocab, share = unpack(r["vocab"], np.int64), unpack(r["shares"], np.uint16).astype(np.int64)
            rank = t.rank_of(vocab)
            symbol = np.where(rank >= 0, rank, FREQUENT + share).astype(np.uint16)
            floor = np.log10(t.tokens + 0.1 * (t.distinct + 1))
            base = np.log10(c + 0.1) - floor
            rest = np.where(rank >= 0, 0.0, np.log10(c + 0.1) - np.log10(t.share_count[share] + 0.1 * (t.share_words[share] + 1)))
            ids, at = unpack(r["ids"], np.uint32).astype(np.int64), 0
            for doc, out, n in zip(r["docs"], r["held"], r["lens"]):
                own = ids[at:at + n]
                at += n
                rows.append((doc, out, n + 1, int((c[own] > 0).sum()) + (texts > 0), float(base[own].sum() + np.log10(texts + 0.1) - floor),
                             float(rest[own].sum()), np.append(symbol[own], np.uint16(END)).tobytes()))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        names = [c.split()[0] for c in CODED.split(", ")]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    corpus = group_arrow(found.groupBy("block"), counted, "block long, corpus binary")
    ship(blocks.sparkSession)
    coded = blocks.select("block", "docs", "held", "lens", "ids", "vocab", "shares").groupBy("block").cogroup(corpus.groupBy("block")).applyInArrow(code, CODED)
    return materialise(coded, "coded")


# -- training and scoring -------------------------------------------------------------------------

def chunks(batches: Iterator[pa.RecordBatch], tokens: int = 4 * BATCH_TOKENS) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches of about so many tokens, so that texts of like length meet."""
    kept, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            kept.append(batch.slice(i, 64))
            size += sum(len(x) for x in kept[-1].column("symbols").to_pylist()) // 2
            if size >= tokens:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def symbols_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]


def expected_counts(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of all rows: each task sums its texts, then slices of the sums are added up in two steps."""
    held, k = coded.sparkSession.sparkContext.broadcast(model), len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + SYMBOLS * k)
        for batch in chunks(batches):
            for _, lens, grid in batches_of(symbols_of(batch)):
                total += np.concatenate([x.reshape(-1) for x in held.value.counts(grid, lens)])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pack(x) for x in np.array_split(total, SLICES)], pa.binary())],
                                             names=["slice", "sums"])

    def add(table):
        total = reduce(np.add, (unpack(x, np.float64) for x in sorted(table.column("sums").to_pylist())))
        return pa.table({"slice": table.column("slice")[:1], "sums": pa.array([pack(total)], pa.binary())})

    parts = map_arrow(coded.select("symbols"), run, "slice int, sums binary")
    some = group_arrow(parts.groupBy("slice", F.pmod(F.xxhash64("sums"), F.lit(256))), add, "slice int, sums binary")
    got = {r["slice"]: unpack(r["sums"], np.float64) for r in group_arrow(some.groupBy("slice"), add, "slice int, sums binary").collect()}  # SLICES rows
    total = np.concatenate([got[i] for i in range(SLICES)]) if got else np.zeros(k + k * k + SYMBOLS * k)
    return total[:k], total[k:k + k * k].reshape(k, k), total[k + k * k:].reshape(SYMBOLS, k)


def train(coded: DataFrame, base: np.ndarray, *, states: int, passes: int) -> Model:
    training = coded.filter(~F.col("held_out"))
    drawn = training.select("n_tokens", "symbols", F.xxhash64("doc_id", "symbols").alias("_o")).orderBy("_o").limit(START_TOKENS // 200)
    sample, left = [], START_TOKENS
    for row in drawn.toLocalIterator():
        if row["n_tokens"] <= left:
            sample.append(np.frombuffer(bytes(row["symbols"]), np.uint16))
            left -= row["n_tokens"]
    model = first_model(sample, base, states)
    for _ in range(passes):
        model = Model.of(*expected_counts(training, model), base)
    return model


def score_documents(docs: DataFrame, *, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from the rows whose crc32 of the doc_id as text, modulo 10, is not 0 (and from those without doc_id); scores
    every whole text. Tokens are words and one end; null and empty texts are the end alone; unknown words are scored by the
    mass kept for them; repeated rows are learnt from and scored each; an empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = word_blocks(rows)
    texts = blocks.select(F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + (~h).cast("long")))).first()[0] or 0
    words = block_words(blocks)
    counts = materialise(words.groupBy("word").agg(F.first("share").alias("share"), F.sum("n").alias("n")), "word_counts")
    totals = corpus_totals(counts.filter("n > 0"), texts)
    found = words.select("word", "block", "at").join(counts.select("word", "n"), "word").select("block", "at", "n")
    coded = code_documents(blocks, found, totals, texts)
    model = train(coded, totals.base, states=states, passes=passes)
    kept = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            likely = np.zeros(batch.num_rows)
            for at, lens, grid in batches_of(symbols_of(batch)):
                likely[at] = np.log10(kept.value.forward(grid, lens)[1]).sum(0)
            score = likely + batch.column("rest").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    out = map_arrow(coded, run, coded.select(*names).schema.add("score", "double"))
    return out.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
