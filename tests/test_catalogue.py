"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from pulseloom.plans import admission, assembly, catalogue, kernels, modelling, signals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


QUERIES = {**catalogue.QUERIES, **admission.QUERIES, **assembly.QUERIES, **kernels.QUERIES, **signals.QUERIES, **modelling.QUERIES}
SQL = {**catalogue.SQL, **admission.SQL, **assembly.SQL, **kernels.SQL}


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_kernels_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["asof_expiring_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "CartesianProduct" not in plan
