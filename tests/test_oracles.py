"""Every query with SQL gives the same rows in an independent engine."""

import glob
import os

import duckdb
import pytest

from rankforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(None if v != v else v for v in r) for r in df.itertuples(index=False, name=None)]
    return list(df.columns), sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["scenario", "n_users", "recall_at_5", "recall_at_10", "recall_at_20", "recall_at_50"] and got.count() > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
