"""Build a corpus index: blocks, terms, term counts, lexicon, relations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.operators import blocks as bl
from citeloom.operators import counts as ct
from citeloom.operators import lists as ls
from citeloom.operators.filters import FilterIndex, filter_index
from citeloom.operators.lists import KeyedFiles, keyed_files
from citeloom.session import materialise, materialise_bucketed, new_location, read_bucketed, spread, write_bucketed


@dataclass
class CorpusIndex:
    """Tables of one dataset. ``terms`` is bucketed by block, so per-block grouping needs no
    exchange; ``blocks`` is partitioned by ordinal range, so fetching a few blocks prunes.
    Counts, postings, neighbour lists (``pairs``, strongest first) and their heads are keyed
    files in anchor order: a question reads the parts that hold its terms. Relations are spread
    by hash of their whole key and sorted inside each file."""

    spark: SparkSession
    dataset_id: str
    blocks: DataFrame
    terms: DataFrame
    window: int = fv.RELATION_WINDOW
    stop: tuple[str, ...] = fv.STOP_TERMS
    id_prefix: str = "CIT"
    symbol: str = ct.SYMBOL
    saved: dict[str, DataFrame | KeyedFiles] = field(default_factory=dict)

    def holds(self, name: str) -> bool:
        """Whether a table was saved or built before; a single batch reads the terms rather than build lists for itself."""
        return name in self.saved or name in self.__dict__

    @cached_property
    def postings(self) -> DataFrame:
        return ct.postings(self.terms)

    @cached_property
    def posting_lists(self) -> KeyedFiles:
        """One row per term and block, with the number of occurrences."""
        return self.saved.get("posting_lists") or keyed_files(ls.block_postings(self.terms), "posting_lists", "anchor", "block_ordinal")

    @cached_property
    def count_list(self) -> KeyedFiles:
        return self.saved.get("count_list") or keyed_files(ct.anchor_counts(self.terms), "count_list", "anchor")

    @property
    def counts(self) -> DataFrame:
        return self.count_list.rows

    @cached_property
    def lexicon(self) -> DataFrame:
        return self.saved.get("lexicon") or ct.checked_lexicon(self.counts, self.symbol)

    @cached_property
    def relations(self) -> DataFrame:
        return self.saved.get("relations") or sorted_table(
            ct.relation_counts(self.terms, self.window), "relations", "anchor", "neighbor", "offset")

    @cached_property
    def neighbor_lists(self) -> KeyedFiles:
        """Neighbour totals, the list of each anchor in order of impact."""
        return self.saved.get("neighbor_lists") or keyed_files(
            ct.pair_totals(self.relations, self.counts), "neighbor_lists", "anchor", F.desc("observations"), "neighbor")

    @property
    def pairs(self) -> DataFrame:
        return self.neighbor_lists.rows

    @cached_property
    def list_heads(self) -> KeyedFiles:
        return self.saved.get("list_heads") or keyed_files(ls.list_heads(self.pairs, self.stop), "list_heads", "anchor", "level")


    @cached_property
    def filters(self) -> FilterIndex:
        """Time bounds and speaker bitmaps of a chat corpus."""
        return self.saved.get("filters") or filter_index(self.blocks)


KEYED = ("count_list", "posting_lists", "neighbor_lists", "list_heads")


def sorted_table(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write rows as their aggregation left them, spread by hash of the whole key (a hot
    anchor lies in every file), sorted inside each file so that a lookup skips row groups."""
    return materialise(df.sortWithinPartitions(*keys), name)


def block_rows(docs: DataFrame, *, headers: bool = False, id_prefix: str = "CIT") -> DataFrame:
    """Split and, for chat text, attach metadata."""
    return bl.split_documents(docs, id_prefix=id_prefix, headers=headers)


def build_index(docs: DataFrame, dataset_id: str = "default", *, headers: bool = False,
                window: int = fv.RELATION_WINDOW, stop=fv.STOP_TERMS, id_prefix: str = "CIT", symbol: str = ct.SYMBOL) -> CorpusIndex:
    """Blocks and terms are written at once, and the lexicon, so that a colliding ``symbol`` (SQL over ``anchor``) fails the
    build; the other tables are written when first asked for."""
    return index_blocks(block_rows(spread(docs), headers=headers, id_prefix=id_prefix), dataset_id, window=window, stop=stop, id_prefix=id_prefix, symbol=symbol)


def index_blocks(rows: DataFrame, dataset_id: str = "default", *, window: int = fv.RELATION_WINDOW, stop=fv.STOP_TERMS, id_prefix: str = "CIT",
                 symbol: str = ct.SYMBOL) -> CorpusIndex:
    """As ``build_index``, from blocks: those of ``split_documents`` or, for files of any size, of ``line_blocks``."""
    spark = rows.sparkSession
    rows = bl.assign_ordinals(rows, ["source_key", "block_index"], "block_ordinal", range_name="ordinal_range")
    meta = ["chat_metadata"] if "chat_metadata" in rows.columns else []
    blocks = rows.select(
        "block_ordinal", "block_id", "source_path", "line_start", "line_end", "text", "citation_id", "marker",
        "text_hash", *meta, "ordinal_range")
    words = F.col("tokens") if "tokens" in rows.columns else tx.anchors(F.col("text"), stop)
    terms = rows.select("block_ordinal", "ordinal_range", words.alias("terms"))
    terms = materialise_bucketed(terms.withColumn("n_terms", F.size("terms").cast("bigint")), "terms", "block_ordinal")
    index = CorpusIndex(spark, dataset_id, blocks, terms, window, tuple(stop), id_prefix, symbol)
    index.lexicon.schema  # built here: its pass checks the symbols
    return index


def text_relations(docs: DataFrame, *, window: int = fv.RELATION_WINDOW, stop=fv.STOP_TERMS) -> DataFrame:
    """Relations straight from the texts: they need no ordinals, so nothing is put in order or written before they are counted."""
    rows = block_rows(spread(docs))
    words = F.col("tokens") if "tokens" in rows.columns else tx.anchors(F.col("text"), stop)
    return ct.relation_counts(rows.select(words.alias("terms")), window)


def intake_receipt(index: CorpusIndex) -> DataFrame:
    """Totals of a run, one row."""
    t = index.terms.agg(F.count("*").alias("block_count"), F.sum("n_terms").alias("anchor_observation_count"),
                        F.sum(ct.relation_total(F.col("n_terms"), index.window)).alias("relation_observation_count"))
    c = index.counts.agg(F.count("*").alias("unique_anchor_count"))
    s = index.blocks.agg(F.count_distinct("source_path").alias("source_file_count"))
    return one_row(t, c, s)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side (keyed join, one row each)."""
    out = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:
        out = out.join(F.broadcast(part.withColumn("_k", F.lit(1))), "_k")
    return out.drop("_k")


def source_receipt(index: CorpusIndex) -> DataFrame:
    return index.blocks.groupBy("source_path").agg(F.count("*").alias("block_count"))


def save_index(index: CorpusIndex, root: str | None = None) -> str:
    """Write every table of the dataset below ``root``, each in its own layout."""
    root = root or new_location(index.spark, index.dataset_id)
    index.blocks.write.mode("overwrite").partitionBy("ordinal_range").parquet(f"{root}/blocks")
    buckets = write_bucketed(index.terms, f"{root}/terms", "block_ordinal")
    settings = index.spark.createDataFrame(
        [(index.dataset_id, index.window, list(index.stop), index.id_prefix, index.symbol, buckets)],
        "dataset_id string, window int, stop array<string>, id_prefix string, symbol string, term_buckets int")
    settings.write.mode("overwrite").parquet(f"{root}/settings")
    for name in KEYED:
        files: KeyedFiles = getattr(index, name)
        files.table.write.mode("overwrite").partitionBy("part").parquet(f"{root}/{name}")
        files.fences.write.mode("overwrite").parquet(f"{root}/{name}_fences")
    for name, df in (("relations", index.relations), ("lexicon", index.lexicon),
                     ("citations", bl.citations(index.blocks)), ("coordinates", bl.coordinates(index.blocks))):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    if "chat_metadata" in index.blocks.columns:
        bl.chat_index(index.blocks).write.mode("overwrite").partitionBy("date").parquet(f"{root}/chat_index")
        for name in FILTERS:
            getattr(index.filters, name).write.mode("overwrite").parquet(f"{root}/filter_{name}")
    return root


FILTERS = ("bounds", "speakers")
REQUIRED = ("blocks", "terms", "relations", "lexicon", "settings", *KEYED, *(f"{k}_fences" for k in KEYED))


def missing_tables(spark: SparkSession, root: str) -> list[str]:
    """Required tables that cannot be read below ``root``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in REQUIRED if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]


def load_index(spark: SparkSession, root: str, dataset_id: str = "default") -> CorpusIndex:
    """A saved index: terms keep their buckets, lists their parts and fences."""
    missing = missing_tables(spark, root)
    if missing:
        raise FileNotFoundError(f"dataset {dataset_id!r} lacks: {', '.join(missing)}")
    read = {n: spark.read.parquet(f"{root}/{n}") for n in REQUIRED if n != "terms"}
    built = read["settings"].first()
    terms = read_bucketed(spark, f"{root}/terms", "block_ordinal", built["term_buckets"])
    if "chat_metadata" in read["blocks"].columns:
        read["filters"] = FilterIndex(*(spark.read.parquet(f"{root}/filter_{n}") for n in FILTERS))
    lists = {n: KeyedFiles(read[n], "anchor", read[f"{n}_fences"]) for n in KEYED}
    return CorpusIndex(spark, dataset_id, read["blocks"], terms, window=built["window"], stop=tuple(built["stop"]),
                       id_prefix=built["id_prefix"], symbol=built["symbol"],
                       saved={n: read[n] for n in ("relations", "lexicon", "filters") if n in read} | lists)
