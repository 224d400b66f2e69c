"""Catalog expressions: folder names, patterns, calendar keys, durations, defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import measures, names, patterns, periods
from workload.fixtures import AS_OF, CATALOG_SQL, catalog, raw_backups, table


def catalog_records(spark, sf_dir):
    return catalog(spark, sf_dir).drop("size_mb", "size_gb").withColumns({
        "size_mb": F.round(measures.size_mb(F.col("size_bytes")), 2),
        "size_gb": F.round(measures.size_gb(F.col("size_bytes")), 2)})


def folder_names_parsed(spark, sf_dir):
    """Folder names as found in the wild, one form per order key modulo 7, parsed both ways."""
    o = table(spark, sf_dir, "orders")
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    day = periods.day_key(date)
    short = F.concat_ws("-", F.year(date).cast("string"), F.month(date).cast("string"), F.dayofmonth(date).cast("string"))
    form = key % 7
    name = (
        F.when(form == 0, F.concat(F.lit("backup_"), day, F.lit("_10-30-00_"), key.cast("string")))
        .when(form == 1, F.concat(F.lit("backup_"), short, F.lit("_1-3-0_"), key.cast("string"), F.lit("_yy")))
        .when(form == 2, F.concat(F.lit("backup_"), day, F.lit("_23-59-59")))
        .when(form == 3, F.concat(F.lit("backup_"), F.substring(day, 1, 4), F.lit("-13-15_10-30-00_a")))
        .when(form == 4, F.concat(F.lit("manual_"), day, F.lit("_10-30-00_a")))
        .when(form == 5, F.concat(F.lit("_cleanup_reports_"), key.cast("string")))
        .otherwise(F.concat(F.lit("backup_"), day, F.lit("_24-00-00_a"))))
    rows = o.select(key, names.base_name(F.concat(F.lit("base/"), name, F.lit("//"))).alias("folder_name"))
    strict, lenient = names.folder_timestamp(F.col("folder_name")), names.folder_timestamp(F.col("folder_name"), lenient=True)
    return rows.select(
        "o_orderkey", "folder_name", strict.alias("ts"), lenient.alias("lenient_ts"),
        F.when(strict.isNotNull(), names.folder_id(F.col("folder_name"))).alias("backup_id"),
        names.last_part(F.col("folder_name")).alias("last_part"),
        names.is_hidden(F.col("folder_name")).alias("hidden"))


def pattern_selection(spark, sf_dir):
    rows = catalog(spark, sf_dir).select("location", "folder_name")
    include = patterns.parse_list("backup_1996-*, backup_200?-0[1]*, backup_1999-1?-??_*, ,backup_2000-*")
    exclude = patterns.parse_list("*_0000*7, *-31_*")
    return rows.where(patterns.selected(F.col("folder_name"), include, exclude))


def calendar_keys(spark, sf_dir):
    ts = F.col("ts")
    return catalog(spark, sf_dir).select(
        "location", "folder_name", periods.day_key(ts).alias("day"), periods.week_key(ts).alias("week"),
        periods.month_key(ts).alias("month"), "age_days", periods.age_bucket(F.col("age_days")).alias("age_range"),
        periods.layout(ts, periods.LOG_LAYOUT).alias("log_time"),
        periods.layout(ts, periods.REPORT_LAYOUT).alias("report_time"),
        periods.archive_due(F.col("age_days")).alias("archive_due"))


def run_durations(spark, sf_dir):
    """Durations of copies from start and end texts, and of ISO time windows."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("string")
    end = F.timestamp_add("SECOND", F.col("o_custkey") % 7200, F.col("o_orderdate")).cast("string")
    hours, minutes = F.col("o_orderkey") % 30, F.col("o_orderkey") % 61
    iso = F.concat(F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")),
                   minutes.cast("string"), F.lit("M"))
    seconds = periods.duration_seconds(start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    return o.select("o_orderkey", seconds.alias("duration_seconds"), iso.alias("time_window"),
                    periods.iso_seconds(iso).alias("window_seconds"),
                    F.round(seconds / 60, 2).alias("duration_min"))


def manifest_defaults(spark, sf_dir):
    """Missing manifests: unknown lakehouse, no tables; tables joined as text otherwise."""
    rows = raw_backups(spark, sf_dir)
    return rows.select(
        "backup_id", measures.or_unknown(F.col("lakehouse")).alias("source_lakehouse"),
        measures.array_length(F.col("tables")).cast("bigint").alias("tables_count"),
        F.array_join("tables", ", ").alias("tables_text"),
        F.to_json(F.struct("backup_id", "lakehouse")).alias("manifest_json"))


def archive_eligibility(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("due", periods.archive_due(F.col("age_days"), 365))
    return rows.groupBy("location").agg(
        F.count_if("due").alias("due"), F.count_if(~F.col("due")).alias("not_due"),
        F.coalesce(F.sum(F.when(F.col("due"), F.col("size_bytes"))), F.lit(0).cast("bigint")).alias("due_bytes"))


QUERIES = {
    "catalog_records": catalog_records,
    "folder_names_parsed": folder_names_parsed,
    "pattern_selection": pattern_selection,
    "calendar_keys": calendar_keys,
    "run_durations": run_durations,
    "manifest_defaults": manifest_defaults,
    "archive_eligibility": archive_eligibility,
}

ORACLES = {
    "catalog_records": f"""WITH {CATALOG_SQL}
SELECT * REPLACE (round(size_mb, 2) AS size_mb, round(size_gb, 2) AS size_gb) FROM catalog""",
    "folder_names_parsed": r"""WITH n AS (
  SELECT o_orderkey, CASE o_orderkey % 7
    WHEN 0 THEN 'backup_' || strftime(o_orderdate, '%Y-%m-%d') || '_10-30-00_' || o_orderkey
    WHEN 1 THEN 'backup_' || year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || '_1-3-0_' || o_orderkey || '_yy'
    WHEN 2 THEN 'backup_' || strftime(o_orderdate, '%Y-%m-%d') || '_23-59-59'
    WHEN 3 THEN 'backup_' || strftime(o_orderdate, '%Y') || '-13-15_10-30-00_a'
    WHEN 4 THEN 'manual_' || strftime(o_orderdate, '%Y-%m-%d') || '_10-30-00_a'
    WHEN 5 THEN '_cleanup_reports_' || o_orderkey
    ELSE 'backup_' || strftime(o_orderdate, '%Y-%m-%d') || '_24-00-00_a' END AS folder_name
  FROM orders),
p AS (SELECT *, string_split(folder_name, '_') AS parts FROM n),
t AS (SELECT *, CASE WHEN parts[1] = 'backup' AND len(parts) >= 3
    THEN try_strptime(parts[2] || ' ' || parts[3], '%Y-%m-%d %H-%M-%S') END AS lenient_ts FROM p)
SELECT o_orderkey, folder_name, CASE WHEN len(parts) >= 4 THEN lenient_ts END AS ts, lenient_ts,
  CASE WHEN len(parts) >= 4 AND lenient_ts IS NOT NULL THEN parts[4] END AS backup_id, parts[-1] AS last_part,
  folder_name[1] IN ('_', '.') AS hidden
FROM t""",
    "pattern_selection": rf"""WITH {CATALOG_SQL}
SELECT location, folder_name FROM catalog
WHERE (folder_name LIKE 'backup\_1996-%' ESCAPE '\' OR folder_name LIKE 'backup\_1999-1_-__\_%' ESCAPE '\'
  OR folder_name LIKE 'backup\_2000-%' ESCAPE '\')
  AND NOT (folder_name LIKE '%\_0000%7' ESCAPE '\' OR folder_name LIKE '%-31\_%' ESCAPE '\')""",
    "calendar_keys": f"""WITH {CATALOG_SQL}
SELECT location, folder_name, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-W%U') AS week, strftime(ts, '%Y-%m') AS month,
  age_days, CASE WHEN age_days <= 7 THEN '0-7 days' WHEN age_days <= 30 THEN '8-30 days' WHEN age_days <= 90 THEN '31-90 days'
    WHEN age_days <= 365 THEN '91-365 days' ELSE '365+ days' END AS age_range,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS log_time, strftime(ts, '%Y%m%d_%H%M%S') AS report_time, age_days > 30 AS archive_due
FROM catalog""",
    "run_durations": """SELECT o_orderkey, CAST(o_custkey % 7200 AS DOUBLE) AS duration_seconds,
  'PT' || CASE WHEN o_orderkey % 30 > 0 THEN (o_orderkey % 30) || 'H' ELSE '' END || (o_orderkey % 61) || 'M' AS time_window,
  CAST(o_orderkey % 30 * 3600 + o_orderkey % 61 * 60 AS BIGINT) AS window_seconds,
  round((o_custkey % 7200) / 60.0::DOUBLE, 2) AS duration_min FROM orders""",
    "manifest_defaults": """WITH b AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS backup_id, o_orderkey % 11 <> 0 AS has, o_orderpriority, o_orderkey % 20 AS n
  FROM orders)
SELECT backup_id, CASE WHEN has THEN o_orderpriority ELSE 'Unknown' END AS source_lakehouse,
  CASE WHEN has THEN CAST(n + 1 AS BIGINT) ELSE 0 END AS tables_count,
  CASE WHEN has THEN array_to_string(list_transform(range(n + 1), lambda i: 't' || i), ', ') END AS tables_text,
  CASE WHEN has THEN '{"backup_id":"' || backup_id || '","lakehouse":"' || o_orderpriority || '"}'
    ELSE '{"backup_id":"' || backup_id || '"}' END AS manifest_json
FROM b""",
    "archive_eligibility": f"""WITH {CATALOG_SQL}
SELECT location, count(*) FILTER (WHERE age_days > 365) AS due, count(*) FILTER (WHERE age_days <= 365) AS not_due,
  CAST(coalesce(sum(size_bytes) FILTER (WHERE age_days > 365), 0) AS BIGINT) AS due_bytes FROM catalog GROUP BY location""",
}
