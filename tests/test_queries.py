"""Every registered query with SQL gives the rows of its SQL at the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _rows
from test_plans import plan
from workload import jobs, streams

ORACLES = entry.oracle_sql()
SLOW = set(jobs.QUERIES) | set(streams.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = entry.queries()[name](spark, sf_dir)
    text = plan(result)
    # No pairs of rows are formed, and no row leaves the JVM.
    assert not any(word in text for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "InPandas"))
    expected = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert _rows(result.collect(), result.columns) == _rows(expected.fetchall(), expected.columns)


def test_every_query_is_callable_and_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
