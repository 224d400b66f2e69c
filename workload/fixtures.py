"""A backup catalog from ``orders`` and a run log from ``events``, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import measures, names, periods

AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One backup per order: location, ts, backup_id, size and what a manifest would say."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    has_manifest = key % 11 != 0
    return o.select(
        F.col("o_orderstatus").alias("location"),
        F.timestamp_add("SECOND", key * 7919 % 86400, F.col("o_orderdate")).alias("ts"),
        F.lpad(key.cast("string"), 8, "0").alias("backup_id"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") * 1000).alias("size_bytes"),
        F.when(has_manifest, F.col("o_orderpriority")).alias("lakehouse"),
        F.when(has_manifest, F.transform(F.sequence(F.lit(0), key % 20), lambda i: F.concat(F.lit("t"), i.cast("string"))))
        .alias("tables"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = periods.as_of_column(AS_OF)
    rows = raw_backups(spark, sf_dir)
    name = names.folder_name(F.col("ts"), F.col("backup_id"))
    return rows.select(
        "location", name.alias("folder_name"), names.join_path(F.col("location"), name).alias("full_path"),
        "ts", "backup_id", "size_bytes",
        measures.size_mb(F.col("size_bytes")).alias("size_mb"),
        measures.size_gb(F.col("size_bytes")).alias("size_gb"),
        periods.age_days(F.col("ts"), as_of).alias("age_days"),
        measures.or_unknown(F.col("lakehouse")).alias("source_lakehouse"),
        measures.array_length(F.col("tables")).cast("bigint").alias("tables_count"),
        F.when(F.col("lakehouse").isNull(), F.lit("Unknown")).otherwise(F.lit("storage_account")).alias("backup_type"),
    )


CATALOG_SQL = f"""
backups AS (
  SELECT o_orderstatus AS location,
         o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS ts,
         lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS backup_id,
         CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS size_bytes,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS lakehouse,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 20 + 1 AS BIGINT) END AS n_tables
  FROM orders
),
catalog AS (
  SELECT location, 'backup_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || backup_id AS folder_name,
         location || '/backup_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || backup_id AS full_path,
         ts, backup_id, size_bytes, size_bytes / 1048576.0::DOUBLE AS size_mb, size_bytes / 1073741824.0::DOUBLE AS size_gb,
         CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000) AS BIGINT) AS age_days,
         coalesce(lakehouse, 'Unknown') AS source_lakehouse, coalesce(n_tables, 0) AS tables_count,
         CASE WHEN lakehouse IS NULL THEN 'Unknown' ELSE 'storage_account' END AS backup_type
  FROM backups
)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from(table(spark, sf_dir, "events"))


def runs_from(events: DataFrame) -> DataFrame:
    """One pipeline run per event, batch or stream."""
    return events.select(
        F.col("event_id").alias("execution_id"), "ts", "user_id",
        F.element_at(F.array(F.lit("development"), F.lit("staging"), F.lit("production")),
                     (F.col("user_id") % 3 + 1).cast("int")).alias("environment"),
        F.when(F.col("event_type") == "error", F.lit("Failed")).otherwise(F.lit("Success")).alias("status"),
        F.col("value").alias("duration_min"),
        F.get_json_object("props", "$.k").cast("bigint").alias("retries"),
        F.col("event_type").alias("rule_name"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id AS execution_id, ts, user_id,
         CASE user_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'staging' ELSE 'production' END AS environment,
         CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status,
         value AS duration_min, CAST(json_extract_string(props, '$.k') AS BIGINT) AS retries, event_type AS rule_name
  FROM events
)"""
