"""What the physical plans look like: pushed filters, pruned columns, limits before the shuffle."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keepsake.operators import cutoff

def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def large_groups(monkeypatch):
    monkeypatch.setattr(cutoff, "ROWS_IN_ONE_TASK", 1)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(entry.queries()["incremental_rows"](spark, sf_dir))
    assert "GreaterThan(l_shipdate" in text
    text = plan(entry.queries()["storage_by_lakehouse"](spark, sf_dir))
    assert "o_custkey" not in text


@pytest.mark.parametrize("name", ["alerts_throttled", "newest_backups", "structured_alerts"])
def test_top_rows_are_limited_before_the_shuffle(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert text.count("WindowGroupLimit") >= 2


def test_large_groups_are_joined_to_their_cut_without_a_shuffle(spark, sf_dir, large_groups):
    """The final plan is a scan with broadcast joins to written tables of a few rows per location."""
    text = plan(entry.queries()["retention_advanced"](spark, sf_dir))
    assert text.count("BroadcastHashJoin") >= 3
    assert "Window" not in text and "Exchange hashpartitioning" not in text


def test_small_tables_only_are_broadcast(spark, sf_dir, large_groups):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("retention_advanced", "duration_p95", "alerts_escalated", "lakehouse_settings"):
            assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_read_no_columns(spark, sf_dir):
    text = plan(spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.count(F.lit(1))))
    assert "ReadSchema: struct<>" in text
