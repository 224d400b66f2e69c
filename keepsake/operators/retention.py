"""Which backups to delete: by age, count, size, or the three in sequence.

Input is a catalog with ``location, folder_name, ts, size_bytes, age_days``. Every planner returns
the whole catalog with flags, so the caller filters, joins or aggregates as needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions import names, periods
from keepsake.operators.cutoff import Bucket, Key, mark_reached
from keepsake.operators.preservation import with_preservation
from keepsake.options import RetentionOptions
from keepsake.session import settle

NEWEST = [Key("ts", ascending=False), Key("folder_name")]
OLDEST = [Key("ts"), Key("folder_name")]


def _buckets(newest_first: bool) -> list[Bucket]:
    """Day, second, first half of the backup id.

    Folder times have whole seconds and ids have eight characters, so a group has at most 86,400
    seconds in a day, and a second at most 65,536 id halves with as many ids each.
    """
    up = not newest_first
    return [
        Bucket(periods.day_key(F.col("ts")), up),
        Bucket(F.col("ts"), up),
        Bucket(F.substring("folder_name", 1, names.NAME_HEAD), True),
    ]


def _beyond_count(rows: DataFrame, keys: list[str], eligible: Column, max_count: int) -> tuple[DataFrame, Column]:
    """Rows with ``_within``, and the condition for "eligible but not among the newest max_count"."""
    rows = mark_reached(rows, keys, NEWEST, _buckets(newest_first=True), flag="_within",
                        weight=F.when(eligible, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")),
                        budget=lambda _: F.lit(max_count).cast("bigint"))
    return rows, eligible & ~F.col("_within")


def _over_size(rows: DataFrame, keys: list[str], eligible: Column, present: Column, max_size_bytes: int) -> tuple[DataFrame, Column]:
    """Rows with ``_over``, and the condition for "oldest eligible until what is present fits the cap".

    The total includes preserved rows; only eligible rows can be deleted. If deleting all of them
    is not enough, all are deleted.
    """
    nothing = F.lit(0).cast("bigint")
    rows = mark_reached(rows, keys, OLDEST, _buckets(newest_first=False), flag="_over",
                        weight=F.when(eligible, F.col("size_bytes")).otherwise(nothing),
                        total=F.when(present, F.col("size_bytes")).otherwise(nothing),
                        budget=lambda total: total - F.lit(max_size_bytes).cast("bigint"))
    return rows, eligible & F.col("_over")


def plan_deletions(catalog: DataFrame, options: RetentionOptions, keys: list[str] | None = None, written: bool = False) -> DataFrame:
    """Catalog with the preservation flags and ``reason`` (age, count, size or null).

    ``catalog`` already carries ``age_days`` for the chosen clock. Preserved backups never get a
    reason. In advanced mode each stage sees only what the stages before it left. The catalog is read
    several times, so it is written first unless it is ``written`` already.
    """
    keys = keys or ["location"]
    rows = with_preservation(catalog if written else settle(catalog, "catalog"), options.preserve, keys)
    free = ~F.col("preserved")
    old = free & (F.col("age_days") > options.retention_days)
    none = F.lit(None).cast("string")
    if options.mode == "age_based":
        return rows.withColumn("reason", F.when(old, F.lit("age")).otherwise(none))
    if options.mode == "count_based":
        rows, excess = _beyond_count(rows, keys, free, options.max_count)
        return rows.withColumn("reason", F.when(excess, F.lit("count")).otherwise(none)).drop("_within")
    if options.mode == "size_based":
        rows, excess = _over_size(rows, keys, free, F.lit(True), options.max_size_bytes)
        return rows.withColumn("reason", F.when(excess, F.lit("size")).otherwise(none)).drop("_over")
    rows, excess = _beyond_count(rows, keys, free & ~old, options.max_count)
    rows = rows.withColumn("reason", F.when(old, F.lit("age")).when(excess, F.lit("count")).otherwise(none))
    rows = rows.drop("_within")
    remains = F.col("reason").isNull()
    rows, excess = _over_size(rows, keys, free & remains, remains, options.max_size_bytes)
    return rows.withColumn("reason", F.when(excess, F.lit("size")).otherwise(F.col("reason"))).drop("_over")


def plan_summary(plan: DataFrame, keys: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Counts per location: discovered, preserved, deletions by reason, bytes to free, bytes kept."""
    chosen = F.col("reason").isNotNull()
    kept_bytes = F.coalesce(F.sum(F.when(~chosen, F.col("size_bytes"))), F.lit(0).cast("bigint"))
    columns = [
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(F.col("preserved")).alias("preserved"),
        F.count_if(F.col("reason") == "age").alias("delete_age"),
        F.count_if(F.col("reason") == "count").alias("delete_count"),
        F.count_if(F.col("reason") == "size").alias("delete_size"),
        F.count_if(chosen).alias("to_delete"),
        F.count_if(~chosen).alias("kept"),
        F.coalesce(F.sum(F.when(chosen, F.col("size_bytes"))), F.lit(0).cast("bigint")).alias("freed_bytes"),
        kept_bytes.alias("kept_bytes"),
    ]
    if cap is not None:
        columns.append((kept_bytes <= cap).alias("cap_met"))
    return plan.groupBy(*(keys or ["location"])).agg(*columns)


def emergency_plan(catalog: DataFrame, free_bytes: int, respect_preservation: bool = False,
                   keys: list[str] | None = None) -> DataFrame:
    """Catalog with ``selected``: the oldest backups until ``free_bytes`` are freed, per location.

    Includes the backup that reaches the target. Ignores preservation unless asked to respect a
    ``preserved`` column.
    """
    keys = keys or ["location"]
    eligible = ~F.col("preserved") if respect_preservation else F.lit(True)
    if free_bytes <= 0:
        return catalog.withColumn("selected", F.lit(False))
    rows = mark_reached(catalog, keys, OLDEST, _buckets(newest_first=False), flag="selected",
                        weight=F.when(eligible, F.col("size_bytes")).otherwise(F.lit(0).cast("bigint")),
                        budget=lambda _: F.lit(free_bytes).cast("bigint"))
    return rows.withColumn("selected", F.col("selected") & eligible)


def simple_retention(catalog: DataFrame, retention_days: int) -> DataFrame:
    """Age rule alone, without patterns or preservation; a number <= 0 switches it off."""
    due = F.col("age_days") > retention_days if retention_days > 0 else F.lit(False)
    return catalog.withColumn("reason", F.when(due, F.lit("age")))


def without_needed(plan: DataFrame, manifests: DataFrame) -> DataFrame:
    """Plan in which no backup is deleted that a kept increment builds on.

    ``manifests`` holds ``location, folder_name, manifest`` of every backup of the locations, whether
    the plan knows it or not: ``manifest.chain`` lists the folders below an increment down to its full
    backup. Whatever the plan does not delete is kept.
    """
    keys = ["location", "folder_name"]
    doomed = plan.where("reason IS NOT NULL").select(*keys)
    kept = manifests.where(F.size("manifest.chain") > 0).select(*keys, "manifest.chain").join(doomed, keys, "left_anti")
    needed = kept.select("location", F.explode("chain").alias("folder_name")).distinct()
    marked = plan.join(needed.withColumn("_needed", F.lit(True)), keys, "left")
    return marked.withColumn("reason", F.when(F.col("_needed").isNull(), F.col("reason"))).drop("_needed")


def preview(catalog: DataFrame, scenarios: dict[str, RetentionOptions], keys: list[str] | None = None) -> DataFrame:
    """What each scenario would delete, per location, in one result. Nothing is deleted.

    The catalog is written once; every scenario is its own plan over it, reduced to one row per
    location before the results are put together. The catalog is never multiplied by the scenarios.
    """
    keys = keys or ["location"]
    catalog = settle(catalog, "catalog")
    parts = [
        plan_summary(plan_deletions(catalog, options, keys, written=True), keys).select(
            F.lit(name).alias("scenario"), *keys, "discovered", "preserved", "to_delete", "freed_bytes")
        for name, options in scenarios.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def newest(catalog: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n newest backups per location. Spark limits each task to n rows a group before it shuffles."""
    group = W.partitionBy(*(keys or ["location"])).orderBy(*[key.sort() for key in NEWEST])
    return catalog.withColumn("position", F.row_number().over(group).cast("bigint")).where(F.col("position") <= n)
