"""Newest backup per day, week and month, for the latest N periods that have backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions import periods
from keepsake.operators.cutoff import join_groups
from keepsake.options import POLICIES, PreserveOptions
from keepsake.session import settle

FLAGS = ["keep_daily", "keep_weekly", "keep_monthly"]


def preserved_backups(catalog: DataFrame, options: PreserveOptions, keys: list[str]) -> DataFrame:
    """Preserved backups only: keys, ts, folder_name and the three flags.

    Policies are cumulative: weekly includes daily, monthly includes both. Gaps between periods do
    not use up slots. Ties on the newest time go to the smallest folder name.

    The newest time per day is a partial aggregate, so a location's size does not matter; weeks and
    months are read off that table, which has one row per location and day. At most
    daily + weekly + monthly times per location meet the catalog again, for their names. They are
    written first, so that their true size decides how they are joined.
    """
    level = POLICIES.index(options.policy)
    days = catalog.groupBy(*keys, F.col("ts").cast("date").alias("day")).agg(F.max("ts").alias("ts"))
    days = days.select(*keys, "day", "ts", periods.week_key(F.col("ts")).alias("week"),
                       periods.month_key(F.col("ts")).alias("month"))
    group = W.partitionBy(*keys)

    def newest_in(period: str, count: int, wanted: int):
        recent = F.dense_rank().over(group.orderBy(F.col(period).desc())) <= count
        last = F.row_number().over(W.partitionBy(*keys, period).orderBy(F.col("day").desc())) == 1
        return F.lit(level >= wanted) & recent & last

    marked = days.select(
        *keys, "ts",
        newest_in("day", options.daily, 1).alias("keep_daily"),
        newest_in("week", options.weekly, 2).alias("keep_weekly"),
        newest_in("month", options.monthly, 3).alias("keep_monthly"),
    ).where(" OR ".join(FLAGS))
    marked = settle(marked, "preserved")
    named = join_groups(catalog.select(*keys, "ts", "folder_name"), marked, keys + ["ts"])
    return settle(named.groupBy(*keys, "ts", *FLAGS).agg(F.min("folder_name").alias("folder_name")), "preserved")


def with_preservation(catalog: DataFrame, options: PreserveOptions, keys: list[str] | None = None) -> DataFrame:
    """Catalog with keep_daily, keep_weekly, keep_monthly and preserved."""
    keys = keys or ["location"]
    if options.policy == "none":
        none = F.lit(False)
        return catalog.select("*", *[none.alias(flag) for flag in FLAGS], none.alias("preserved"))
    kept = preserved_backups(catalog, options, keys).withColumnRenamed("folder_name", "_kept")
    joined = join_groups(catalog, kept, keys + ["ts"], "left")
    this = F.col("folder_name") == F.col("_kept")
    flagged = joined.withColumns({flag: F.coalesce(this & F.col(flag), F.lit(False)) for flag in FLAGS}).drop("_kept")
    return flagged.withColumn("preserved", F.col("keep_daily") | F.col("keep_weekly") | F.col("keep_monthly"))
