"""Every check query belongs to a registered one, and a few run against the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="tables not present")


def test_keys():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["block_split", "anchor_counts", "top_neighbors", "qualified_evidence", "cited_answers", "support_ladder",
                                  "watchlist_hits", "message_routing", "incremental_counts"])
def test_matches_sql(spark, name):
    df = entry_module.queries()[name](spark, ROOT)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "conversations", "benchmark", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(tidy(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(tidy(v) for v in r) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
