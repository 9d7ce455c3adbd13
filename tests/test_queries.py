"""Every registered query of the language against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from lanternql import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert ordered(rows) == ordered(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_filters_reach_the_scan(spark):
    df = queries.QUERIES["fl2_comparisons"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
