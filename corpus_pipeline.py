"""Training-corpus pipeline over ``documents``: each stage reads what the one before it wrote.

quality classifier -> near duplicates (five-word shingles, similarity 0.8) -> benchmark decontamination -> source mix ->
token shards. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from citeloom.llm import jaccard_join, leaks, mixing, quality, tasks, token_planes  # noqa: E402
from citeloom.session import materialise  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    tasks.short_batches(spark)
    return quality.accepted(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group that links of similarity 0.8 connect."""
    tasks.short_batches(spark)
    return jaccard_join.first_of_groups(docs.select(*COLUMNS), n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch near a test item."""
    tasks.short_batches(spark)
    return leaks.without_leaks(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 150 % of all words, sources weighing 5, 2, 1."""
    return mixing.take(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all rows, read back: doc_id, start, n_tokens, ids_crc32."""
    tasks.short_batches(spark)
    return token_planes.encode_documents(docs.select(*COLUMNS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("token_planes", write_token_shards),
]
#: No SQL: the classifier is trained, edit matching and tokenizing have no SQL form. tests/llm hold the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; every stage's result is written and reread."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
