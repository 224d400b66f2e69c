"""Storage analysis and the cleanup report, all from the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import measures, periods
from keepsake.operators.retention import NEWEST


def storage_totals(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Count, total and average size, largest, smallest, oldest and newest backup per group.

    Ties go to the newest backup, then to the smallest name.
    """
    newest_first = [-periods.epoch_us(F.col("ts")), F.col("folder_name")]
    return catalog.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_backups"),
        F.sum("size_bytes").alias("total_size_bytes"),
        F.round(measures.size_gb(F.sum("size_bytes")), 6).alias("total_size_gb"),
        F.round(measures.size_gb(F.sum("size_bytes")) / F.count(F.lit(1)), 6).alias("avg_size_gb"),
        F.min_by("folder_name", F.struct(-F.col("size_bytes"), *newest_first)).alias("largest_backup"),
        F.min_by("folder_name", F.struct(F.col("size_bytes"), *newest_first)).alias("smallest_backup"),
        F.min_by("folder_name", F.struct("ts", "folder_name")).alias("oldest_backup"),
        F.min_by("folder_name", F.struct(*newest_first)).alias("newest_backup"),
        F.max("age_days").alias("oldest_age_days"),
        F.min("age_days").alias("newest_age_days"),
    )


def by_lakehouse(catalog: DataFrame, keys: list[str]) -> DataFrame:
    return catalog.groupBy(*keys, "source_lakehouse").agg(
        F.count(F.lit(1)).alias("backups"), F.sum("size_bytes").alias("size_bytes"),
        F.round(measures.size_gb(F.sum("size_bytes")), 2).alias("size_gb"))


def by_age_bucket(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Count and bytes for each of the five age buckets, empty buckets included."""
    bucket = periods.age_bucket(F.col("age_days"))
    labels = [label for label, _ in periods.AGE_BUCKETS]
    sums = catalog.withColumn("_bucket", bucket).groupBy(*keys).agg(*[
        F.struct(F.lit(label).alias("age_range"),
                 F.count_if(F.col("_bucket") == label).alias("backups"),
                 F.coalesce(F.sum(F.when(F.col("_bucket") == label, F.col("size_bytes"))), F.lit(0).cast("bigint"))
                 .alias("size_bytes")).alias(f"_{i}")
        for i, label in enumerate(labels)])
    return sums.select(*keys, F.inline(F.array(*[f"_{i}" for i in range(len(labels))])))


def bucket_members(catalog: DataFrame) -> DataFrame:
    """Every backup with its age bucket, one row each."""
    return catalog.withColumn("age_range", periods.age_bucket(F.col("age_days")))


def inventory(plan: DataFrame) -> DataFrame:
    """The report's list of backups; order it with ``newest_first`` for display."""
    return plan.select(
        "location", "folder_name", periods.layout(F.col("ts"), periods.LOG_LAYOUT).alias("timestamp"), "age_days",
        "size_gb", "source_lakehouse", "tables_count", measures.preservation_status(F.col("preserved")).alias("status"))


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(*[key.sort() for key in NEWEST])


def report(plan: DataFrame, as_of: Column, mode: str, policy: str, dry_run: bool, keys: list[str]) -> DataFrame:
    """One summary row per location, from the plan with its ``reason`` and ``preserved`` columns."""
    chosen = F.col("reason").isNotNull()
    return plan.groupBy(*keys).agg(
        periods.layout(as_of, periods.LOG_LAYOUT).alias("report_timestamp"),
        F.lit(mode).alias("cleanup_mode"), F.lit(dry_run).alias("dry_run"), F.lit(policy).alias("preserve_policy"),
        F.count(F.lit(1)).alias("total_backups_discovered"),
        F.count_if("preserved").alias("total_backups_preserved"),
        F.count_if(chosen).alias("total_backups_deleted"),
        F.round(measures.size_gb(F.sum("size_bytes")), 6).alias("total_size_discovered_gb"),
        F.round(measures.size_gb(F.coalesce(F.sum(F.when(chosen, F.col("size_bytes"))), F.lit(0))), 6)
        .alias("total_size_freed_gb"),
        F.coalesce(periods.layout(F.min("ts"), periods.LOG_LAYOUT), F.lit("N/A")).alias("oldest_backup"),
        F.coalesce(periods.layout(F.max("ts"), periods.LOG_LAYOUT), F.lit("N/A")).alias("newest_backup"),
    )


def operation_totals(results: DataFrame, keys: list[str]) -> DataFrame:
    """Processed, successful, failed, bytes freed and status of a cleanup; a dry run counts as success."""
    ok = F.col("error").isNull() & (F.col("deleted") | F.col("would_delete"))
    sums = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0).cast("bigint")).alias("freed_bytes"))
    return sums.withColumn("status", measures.run_status(F.col("failed"), F.col("successful")))
