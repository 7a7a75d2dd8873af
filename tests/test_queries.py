"""Every query with SQL gives the rows DuckDB gives; every other one runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of

SLOW = {
    "clf_linear_svc", "clf_rbf_svm", "reg_svr", "reg_linear_svr", "cluster_search", "cluster_baselines", "tuned_candidates", "recommender_accuracy",
    "meta_features_clustering",
}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    res = con.execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
