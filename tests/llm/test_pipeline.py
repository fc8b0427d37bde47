"""Stages one by one and the registered queries that have check SQL."""

import os

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from citeloom.llm import oracle, queries
from citeloom.llm import jaccard_join, leaks, quality

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def test_stage_columns_and_decisions(spark):
    docs = cp._table(spark, SF, "documents")
    bad = {r.doc_id for r in quality.classify(docs, cp._table(spark, SF, "labels")).filter("predicted = 0").collect()}
    kept = cp.keep_quality(spark, docs, SF)
    assert kept.columns == list(cp.COLUMNS)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    single = cp.drop_near_duplicates(spark, docs, SF)
    groups = jaccard_join.near_duplicates(docs, n=5, percent=80).collect()
    assert single.columns == list(cp.COLUMNS)
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    leaked = {r.doc_id for r in leaks.find_leaks(docs, cp._table(spark, SF, "benchmark")).collect()}
    clean = cp.drop_benchmark(spark, docs, SF)
    assert leaked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaked
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == list(cp.COLUMNS) and mixed.count() > docs.count()


def test_stages_survive_no_documents(spark):
    docs = cp._table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_hand_short_batches_to_python(spark):
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    rows = spark.range(5000).repartition(1)
    sizes = lambda: [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    try:
        for name, stage in cp.STAGES:
            if name == "source_mixing":  # native
                continue
            spark.conf.set(most, "10000")
            stage(spark, cp._table(spark, SF, "documents"), SF)
            assert max(sizes()) <= 1000 and sum(sizes()) == 5000, name
        spark.conf.set(most, "300")
        cp.tasks.short_batches(spark)
        assert max(sizes()) <= 300
    finally:
        spark.conf.set(most, before)


def test_run_writes_every_kept_row(spark):
    out = cp.run(spark, SF).orderBy("start").collect()
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert at > 0


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_check_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({oracle.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
