"""Storage analysis and cleanup report."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import periods
from keepsake.operators import retention as ret
from keepsake.options import PreserveOptions, RetentionOptions
from keepsake.plans import analysis
from workload.fixtures import AS_OF, CATALOG_SQL, catalog
from workload.retention import _AGE, _keyed, DAYS

LOCATION = ["location"]


def _plan(spark, sf_dir):
    return ret.plan_deletions(catalog(spark, sf_dir),
                              RetentionOptions("age_based", DAYS, preserve=PreserveOptions("monthly")))


def storage_totals(spark, sf_dir):
    return analysis.storage_totals(catalog(spark, sf_dir), LOCATION)


def storage_by_lakehouse(spark, sf_dir):
    return analysis.by_lakehouse(catalog(spark, sf_dir), LOCATION)


def storage_by_age(spark, sf_dir):
    return analysis.by_age_bucket(catalog(spark, sf_dir), LOCATION)


def age_bucket_members(spark, sf_dir):
    return analysis.bucket_members(catalog(spark, sf_dir)).select("age_range", "location", "folder_name", "size_bytes")


def cleanup_report(spark, sf_dir):
    return analysis.report(_plan(spark, sf_dir), periods.as_of_column(AS_OF), "age_based", "monthly", True, LOCATION)


def cleanup_inventory(spark, sf_dir):
    rows = analysis.inventory(_plan(spark, sf_dir))
    return rows.withColumn("size_gb", F.round("size_gb", 2))


def operation_totals(spark, sf_dir):
    """Totals of a cleanup in which some deletes failed."""
    key = F.col("backup_id").cast("bigint")
    results = _plan(spark, sf_dir).where("reason IS NOT NULL").select(
        "location", "folder_name", "size_bytes",
        F.lit(True).alias("would_delete"),
        (key % 13 != 0).alias("deleted"),
        F.when((key % 13 == 0) & (F.col("location") != "P"), F.lit("access denied")).alias("error"))
    return analysis.operation_totals(results, LOCATION)


QUERIES = {
    "storage_totals": storage_totals,
    "storage_by_lakehouse": storage_by_lakehouse,
    "storage_by_age": storage_by_age,
    "age_bucket_members": age_bucket_members,
    "cleanup_report": cleanup_report,
    "cleanup_inventory": cleanup_inventory,
    "operation_totals": operation_totals,
}

_BUCKET = """CASE WHEN age_days <= 7 THEN '0-7 days' WHEN age_days <= 30 THEN '8-30 days' WHEN age_days <= 90 THEN '31-90 days'
  WHEN age_days <= 365 THEN '91-365 days' ELSE '365+ days' END"""

ORACLES = {
    "storage_totals": f"""WITH {CATALOG_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY size_bytes DESC, ts DESC, folder_name) AS big,
    row_number() OVER (PARTITION BY location ORDER BY size_bytes, ts DESC, folder_name) AS small,
    row_number() OVER (PARTITION BY location ORDER BY ts, folder_name) AS old,
    row_number() OVER (PARTITION BY location ORDER BY ts DESC, folder_name) AS new FROM catalog)
SELECT location, count(*) AS total_backups, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
  round(CAST(sum(size_bytes) AS BIGINT) / 1073741824.0::DOUBLE, 6) AS total_size_gb,
  round(CAST(sum(size_bytes) AS BIGINT) / 1073741824.0::DOUBLE / count(*), 6) AS avg_size_gb,
  max(folder_name) FILTER (WHERE big = 1) AS largest_backup, max(folder_name) FILTER (WHERE small = 1) AS smallest_backup,
  max(folder_name) FILTER (WHERE old = 1) AS oldest_backup, max(folder_name) FILTER (WHERE new = 1) AS newest_backup,
  max(age_days) AS oldest_age_days, min(age_days) AS newest_age_days
FROM r GROUP BY location""",
    "storage_by_lakehouse": f"""WITH {CATALOG_SQL}
SELECT location, source_lakehouse, count(*) AS backups, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  round(CAST(sum(size_bytes) AS BIGINT) / 1073741824.0::DOUBLE, 2) AS size_gb FROM catalog GROUP BY ALL""",
    "storage_by_age": f"""WITH {CATALOG_SQL}, b AS (SELECT *, {_BUCKET} AS age_range FROM catalog),
labels AS (SELECT unnest(['0-7 days', '8-30 days', '31-90 days', '91-365 days', '365+ days']) AS age_range),
grid AS (SELECT location, age_range FROM (SELECT DISTINCT location FROM catalog), labels)
SELECT g.location, g.age_range, count(b.folder_name) AS backups, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes
FROM grid g LEFT JOIN b ON b.location = g.location AND b.age_range = g.age_range GROUP BY ALL""",
    "age_bucket_members": f"WITH {CATALOG_SQL} SELECT {_BUCKET} AS age_range, location, folder_name, size_bytes FROM catalog",
    "cleanup_report": f"""WITH {_keyed(3)}, {_AGE}
SELECT location, '{AS_OF}' AS report_timestamp, 'age_based' AS cleanup_mode, true AS dry_run, 'monthly' AS preserve_policy,
  count(*) AS total_backups_discovered, count(*) FILTER (WHERE preserved) AS total_backups_preserved,
  count(reason) AS total_backups_deleted,
  round(CAST(sum(size_bytes) AS BIGINT) / 1073741824.0::DOUBLE, 6) AS total_size_discovered_gb,
  round(CAST(coalesce(sum(size_bytes) FILTER (WHERE reason IS NOT NULL), 0) AS BIGINT) / 1073741824.0::DOUBLE, 6) AS total_size_freed_gb,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest_backup, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest_backup
FROM staged GROUP BY location""",
    "cleanup_inventory": f"""WITH {_keyed(3)}, {_AGE}
SELECT location, folder_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, age_days, round(size_gb, 2) AS size_gb,
  source_lakehouse, tables_count, CASE WHEN preserved THEN 'Preserved' ELSE 'Available for cleanup' END AS status FROM staged""",
    "operation_totals": f"""WITH {_keyed(3)}, {_AGE}, r AS (
  SELECT location, size_bytes, NOT (CAST(backup_id AS BIGINT) % 13 = 0 AND location <> 'P') AS ok FROM staged WHERE reason IS NOT NULL)
SELECT location, count(*) AS processed, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed,
  CAST(coalesce(sum(size_bytes) FILTER (WHERE ok), 0) AS BIGINT) AS freed_bytes,
  CASE WHEN count(*) FILTER (WHERE NOT ok) = 0 THEN 'success' WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed'
    ELSE 'partial_success' END AS status
FROM r GROUP BY location""",
}
