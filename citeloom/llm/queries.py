"""Registered queries of the training-corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import digest_runs, hmm_lm, jaccard_join, leaks, mixing, prefix_audit, quality, site_tree, token_lockstep, token_planes, unit_dedup, url_templates, vector_forest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Fixed values of the url query: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")


@query
def op8_url_templates(spark: SparkSession, root: str) -> DataFrame:
    return url_templates.judge_urls(read(spark, root, "pages"), URL_RULES)


@query
def op9_source_mix(spark: SparkSession, root: str) -> DataFrame:
    rows = mixing.sized(read(spark, root, "documents"), read(spark, root, "labels"))
    return mixing.mix(rows).select("doc_id", "source", "size", "source_size", "target", "taken", "epochs")


@query
def op10_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.classify(read(spark, root, "documents"), read(spark, root, "labels"))


@query
def op7_token_planes(spark: SparkSession, root: str) -> DataFrame:
    return token_planes.encode_documents(read(spark, root, "documents"))


@query
def op5_ngram_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, root, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query
def op2_benchmark_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(read(spark, root, "documents"), read(spark, root, "benchmark"))


@query
def op6_unit_dedup(spark: SparkSession, root: str) -> DataFrame:
    return unit_dedup.dedup_units(read(spark, root, "documents"))


@query
def op3_vector_forest(spark: SparkSession, root: str) -> DataFrame:
    return vector_forest.nearest(read(spark, root, "embeddings"))


@query
def op4_hidden_markov(spark: SparkSession, root: str) -> DataFrame:
    return hmm_lm.score_documents(read(spark, root, "documents"))


@query
def op1_site_tree(spark: SparkSession, root: str) -> DataFrame:
    return site_tree.extract_text(read(spark, root, "pages"))


@query
def op11_digest_runs(spark: SparkSession, root: str) -> DataFrame:
    return digest_runs.exact_copies(read(spark, root, "documents"))


@query
def op12_token_lockstep(spark: SparkSession, root: str) -> DataFrame:
    return token_lockstep.alignment_digests(read(spark, root, "documents"))


@query
def op13_prefix_audit(spark: SparkSession, root: str) -> DataFrame:
    return prefix_audit.divergences(read(spark, root, "documents"))


@query
def pipeline(spark: SparkSession, root: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)
