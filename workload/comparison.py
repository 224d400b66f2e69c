"""Verification, table sets, selection, increments."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from keepsake.operators import costs, reconcile as rec, selection
from keepsake.operators.running import prior_sums
from keepsake.options import BackupOptions
from keepsake.plans.backup import backup
from keepsake.session import fresh_path
from keepsake.sources import config
from workload.fixtures import CATALOG_SQL, RUNS_SQL, catalog, run_log, table

KEYS = ["lakehouse", "table_name"]


def _table_counts(lines):
    """Every supplier is a lakehouse, every part it ships a table, every line a row."""
    return lines.groupBy(F.col("l_suppkey").alias("lakehouse"),
                         F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("table_name")).agg(
        F.count(F.lit(1)).alias("rows"))


def _verification(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    source = _table_counts(lines.where(F.col("l_orderkey") % 331 != 7))
    copy = _table_counts(lines.where(F.col("l_orderkey") % 97 != 5))
    return rec.reconcile(source, copy, KEYS)


def count_reconciliation(spark, sf_dir):
    return _verification(spark, sf_dir)


def verification_rollup(spark, sf_dir):
    return rec.all_verified(_verification(spark, sf_dir), ["lakehouse"])


def backup_quality_scores(spark, sf_dir):
    rollup = rec.all_verified(_verification(spark, sf_dir), ["lakehouse"])
    return rec.quality_scores(rollup.withColumn("region", F.col("lakehouse") % 5), ["region"])


def _two_backups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("lakehouse"), "l_returnflag",
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("table_name"))
    return lines.where("l_returnflag IN ('A', 'N')").drop("l_returnflag"), lines.where("l_returnflag = 'R'").drop("l_returnflag")


def tables_compared(spark, sf_dir):
    return rec.compare_tables(*_two_backups(spark, sf_dir), ["lakehouse"])


def tables_in_both(spark, sf_dir):
    return rec.compare_tables(*_two_backups(spark, sf_dir), ["lakehouse"]).where("place = 'common'").drop("place")


def tables_only_in_first(spark, sf_dir):
    return rec.compare_tables(*_two_backups(spark, sf_dir), ["lakehouse"]).where("place = 'only_in_first'").drop("place")


def restore_selection(spark, sf_dir):
    """Restore requests with an explicit list, a manifest, or only a folder scan."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    requests = o.select(
        key.alias("request"),
        F.when(key % 3 == 0, F.concat(F.lit(" orders, ,part_"), (key % 10).cast("string"), F.lit(",")))
        .when(key % 3 == 1, F.lit("  ")).alias("explicit"),
        F.when(key % 2 == 0, F.array(F.lit("customer"), F.concat(F.lit("line_"), (key % 4).cast("string")))).alias("manifest"),
        F.array(F.lit("_manifest"), F.lit(".crc"), F.lit("events")).alias("scanned"))
    return selection.tables_to_restore(requests, "explicit", "manifest", "scanned")


def restored_without_failed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    requested = _table_counts(lines).drop("rows")
    failed = _table_counts(lines.where(F.col("l_discount") >= 0.09)).drop("rows")
    return rec.restored_tables(requested, failed, KEYS)


_LAKEHOUSES = [
    {"name": "ECONOMY", "workspaceId": "sales", "tableFilter": "small*, large *"},
    {"name": "STANDARD", "workspaceId": "finance", "tableFilter": "* ring,r?d *"},
    {"name": "PROMO", "workspaceId": "operations", "tableFilter": "*"},
]


def lakehouse_tables(spark, sf_dir):
    """Parts as tables of the lakehouse named by their type, filtered by its patterns."""
    tables = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("table_name"), F.col("p_type").alias("lakehouse"))
    documents = spark.range(1).select(F.lit(json.dumps(_LAKEHOUSES)).alias("document"))
    return selection.filtered(tables, config.lakehouse_list(documents))


def lakehouse_settings(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    lakehouses = customers.select(
        F.col("c_name").alias("name"),
        F.element_at(F.array(F.lit("development"), F.lit("staging"), F.lit("production")),
                     (F.col("c_custkey") % 3 + 1).cast("int")).alias("environment"))
    rows = selection.with_settings(lakehouses, selection.environment_settings(spark), F.lit("abfss://backups@store"))
    return rows.withColumn("retentionDays", F.col("retentionDays").cast("bigint"))


def consolidated_report(spark, sf_dir):
    runs = run_log(spark, sf_dir).withColumn("lakehouse", F.col("user_id"))
    return costs.consolidated(runs, ["environment"])


def overall_run_status(spark, sf_dir):
    runs = run_log(spark, sf_dir).select(
        "execution_id", F.col("status").alias("backup_status"), (F.col("user_id") % 4 != 0).alias("cleanup_enabled"),
        F.when(F.col("retries") % 5 == 0, F.lit("Failed")).when(F.col("retries") % 5 > 1, F.lit("Success")).alias("cleanup_status"))
    return costs.overall_status(runs)


def incremental_rows(spark, sf_dir):
    """Rows past the mark that the full backup of everything shipped before 2000 left."""
    lines = table(spark, sf_dir, "lineitem")
    mark = lines.where("l_shipdate < timestamp_ntz '2000-01-01'").agg(F.max("l_shipdate")).first()[0]
    new = rec.rows_after(lines, "l_shipdate", F.lit(str(mark)).cast("timestamp_ntz") if mark else None)
    return new.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


def incremental_changes(spark, sf_dir):
    """Orders that are new or changed since an earlier copy, by key and row hash."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    earlier = o.where(key % 7 != 0).withColumn(
        "o_totalprice", F.when(key % 5 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")))
    return rec.changed_rows(o, earlier, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def differential_rows(spark, sf_dir):
    """Per increment day: rows since the last increment, and since the full backup of 1999."""
    lines = table(spark, sf_dir, "lineitem")
    full = F.lit("1999-12-31 00:00:00").cast("timestamp_ntz")
    since = rec.rows_after(lines, "l_shipdate", full)
    days = since.groupBy(F.col("l_shipdate").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("incremental"))
    before = prior_sums(days.withColumn("backup", F.lit("full")), ["backup"], ["day"], [F.substring("day", 1, 4), F.substring("day", 1, 7)],
                        {"rows": F.col("incremental")})
    return before.select("day", "incremental", (F.col("prior_rows") + F.col("incremental")).cast("bigint").alias("differential"))


def partition_filter(spark, sf_dir):
    """What a backup with a partition filter holds."""
    only = BackupOptions("test lake", fresh_path(spark, "filtered"), table_filter="lineitem", retention_days=0,
                         partition_filter="l_shipdate >= timestamp_ntz '2000-01-01' AND l_returnflag = 'N'")
    lines = spark.read.parquet(f"{backup(spark, sf_dir, only).path}/lineitem")
    return lines.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_quantity")).cast("bigint")).alias("quantity"))


def sampled_restore(spark, sf_dir):
    return rec.sample_for_test(catalog(spark, sf_dir), 5, "week-31").select("location", "folder_name")


QUERIES = {
    "count_reconciliation": count_reconciliation,
    "verification_rollup": verification_rollup,
    "backup_quality_scores": backup_quality_scores,
    "tables_compared": tables_compared,
    "tables_in_both": tables_in_both,
    "tables_only_in_first": tables_only_in_first,
    "restore_selection": restore_selection,
    "restored_without_failed": restored_without_failed,
    "lakehouse_tables": lakehouse_tables,
    "lakehouse_settings": lakehouse_settings,
    "consolidated_report": consolidated_report,
    "overall_run_status": overall_run_status,
    "incremental_rows": incremental_rows,
    "incremental_changes": incremental_changes,
    "differential_rows": differential_rows,
    "partition_filter": partition_filter,
    "sampled_restore": sampled_restore,
}

_VERIFY = """v AS (
  SELECT coalesce(s.lakehouse, c.lakehouse) AS lakehouse, coalesce(s.table_name, c.table_name) AS table_name,
    s.rows AS source_rows, c.rows AS backup_rows, coalesce(s.rows = c.rows, false) AS verified,
    CASE WHEN s.rows IS NULL THEN 'missing in source' WHEN c.rows IS NULL THEN 'missing in backup'
      WHEN s.rows <> c.rows THEN 'row counts differ' END AS error
  FROM (SELECT l_suppkey AS lakehouse, 'part_' || l_partkey AS table_name, count(*) AS rows FROM lineitem
        WHERE l_orderkey % 331 <> 7 GROUP BY ALL) s
  FULL OUTER JOIN (SELECT l_suppkey AS lakehouse, 'part_' || l_partkey AS table_name, count(*) AS rows FROM lineitem
        WHERE l_orderkey % 97 <> 5 GROUP BY ALL) c ON s.lakehouse = c.lakehouse AND s.table_name = c.table_name)"""
_ROLLUP = """r AS (
  SELECT lakehouse, bool_and(verified) AS all_verified, count(*) AS tables, count(*) FILTER (WHERE NOT verified) AS failed,
    CAST(coalesce(sum(source_rows), 0) AS BIGINT) AS expected_rows, CAST(coalesce(sum(backup_rows), 0) AS BIGINT) AS copied_rows
  FROM v GROUP BY lakehouse)"""
_FIRST = "SELECT DISTINCT l_suppkey AS lakehouse, 'part_' || l_partkey AS table_name FROM lineitem WHERE l_returnflag IN ('A', 'N')"
_SECOND = "SELECT DISTINCT l_suppkey AS lakehouse, 'part_' || l_partkey AS table_name FROM lineitem WHERE l_returnflag = 'R'"

ORACLES = {
    "count_reconciliation": f"WITH {_VERIFY} SELECT * FROM v",
    "verification_rollup": f"WITH {_VERIFY}, {_ROLLUP} SELECT * FROM r",
    "backup_quality_scores": f"""WITH {_VERIFY}, {_ROLLUP}
SELECT lakehouse % 5 AS region, round(100.0::DOUBLE * count(*) FILTER (WHERE all_verified) / count(*), 6) AS backup_integrity_score,
  round(100.0::DOUBLE * CAST(sum(copied_rows) AS BIGINT) / CAST(sum(expected_rows) AS BIGINT), 6) AS data_completeness_score,
  100.0::DOUBLE * count(*) FILTER (WHERE all_verified) / count(*) < 99.5 AS integrity_alert,
  100.0::DOUBLE * CAST(sum(copied_rows) AS BIGINT) / CAST(sum(expected_rows) AS BIGINT) < 99.5 AS completeness_alert
FROM r GROUP BY ALL""",
    "tables_compared": f"""WITH a AS ({_FIRST}), b AS ({_SECOND})
SELECT coalesce(a.lakehouse, b.lakehouse) AS lakehouse, coalesce(a.table_name, b.table_name) AS table_name,
  CASE WHEN b.lakehouse IS NULL THEN 'only_in_first' WHEN a.lakehouse IS NULL THEN 'only_in_second' ELSE 'common' END AS place
FROM a FULL OUTER JOIN b ON a.lakehouse = b.lakehouse AND a.table_name = b.table_name""",
    "tables_in_both": f"{_FIRST} INTERSECT {_SECOND}",
    "tables_only_in_first": f"{_FIRST} EXCEPT {_SECOND}",
    "restore_selection": """WITH q AS (SELECT o_orderkey AS k FROM orders),
s AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'explicit' WHEN k % 2 = 0 THEN 'manifest' ELSE 'scan' END AS origin FROM q)
SELECT k AS request, origin, unnest(CASE origin WHEN 'explicit' THEN ['orders', 'part_' || (k % 10)]
  WHEN 'manifest' THEN ['customer', 'line_' || (k % 4)] ELSE ['events'] END) AS table_name FROM s""",
    "restored_without_failed": """SELECT DISTINCT l_suppkey AS lakehouse, 'part_' || l_partkey AS table_name FROM lineitem
EXCEPT SELECT l_suppkey, 'part_' || l_partkey FROM lineitem WHERE l_discount >= 0.09""",
    "lakehouse_tables": """SELECT p_type AS lakehouse, p_partkey, p_name AS table_name,
  CASE p_type WHEN 'ECONOMY' THEN 'sales' WHEN 'STANDARD' THEN 'finance' ELSE 'operations' END AS workspaceId
FROM part WHERE (p_type = 'ECONOMY' AND (p_name LIKE 'small%' OR p_name LIKE 'large %'))
  OR (p_type = 'STANDARD' AND (p_name LIKE '% ring' OR p_name LIKE 'r_d %')) OR p_type = 'PROMO'""",
    "lakehouse_settings": """SELECT c_name AS name, e.environment, "backupMode", "retentionDays", "cleanupEnabled", "preservePolicy",
  'abfss://backups@store/' || c_name AS backup_location
FROM customer JOIN (VALUES (0, 'development', 'incremental', 7::BIGINT, true, 'daily'), (1, 'staging', 'full', 14, true, 'weekly'),
  (2, 'production', 'full', 90, true, 'monthly')) e(k, environment, "backupMode", "retentionDays", "cleanupEnabled", "preservePolicy")
  ON c_custkey % 3 = e.k""",
    "consolidated_report": f"""WITH {RUNS_SQL}, last AS (
  SELECT environment, user_id, status, row_number() OVER (PARTITION BY environment, user_id ORDER BY ts DESC, execution_id DESC) AS rn,
    count(*) OVER (PARTITION BY environment, user_id) AS runs FROM runs)
SELECT environment, count(*) AS lakehouses, CAST(sum(runs) AS BIGINT) AS runs, count(*) FILTER (WHERE status = 'Success') AS succeeded,
  count(*) FILTER (WHERE status = 'Failed') AS failed FROM last WHERE rn = 1 GROUP BY environment""",
    "overall_run_status": f"""WITH {RUNS_SQL}, x AS (SELECT execution_id, status AS backup_status, user_id % 4 <> 0 AS cleanup_enabled,
  CASE WHEN retries % 5 = 0 THEN 'Failed' WHEN retries % 5 > 1 THEN 'Success' END AS cleanup_status FROM runs)
SELECT *, CASE WHEN backup_status = 'Success' AND (NOT cleanup_enabled OR cleanup_status IS NULL OR cleanup_status <> 'Failed')
  THEN 'Success' ELSE 'Failed' END AS overall_status FROM x""",
    "incremental_rows": """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')""",
    "incremental_changes": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0",
    "differential_rows": """WITH d AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS incremental FROM lineitem
  WHERE l_shipdate > TIMESTAMP '1999-12-31' GROUP BY ALL)
SELECT day, incremental, CAST(sum(incremental) OVER (ORDER BY day) AS BIGINT) AS differential FROM d""",
    "partition_filter": """SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'N' GROUP BY ALL""",
    "sampled_restore": f"""WITH {CATALOG_SQL} SELECT location, folder_name FROM catalog
WHERE CAST('0x' || substr(md5(folder_name || 'week-31'), 1, 8) AS BIGINT) < 214748364""",
}
