"""Discover, preserve, plan, delete and report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import names, periods
from keepsake.operators.retention import plan_deletions, without_needed
from keepsake.options import CleanupOptions
from keepsake.plans import analysis
from keepsake.plans.discover import discover
from keepsake.plans.verify import per_table
from keepsake.session import settle
from keepsake.sources.manifests import all_manifests
from keepsake.sources.storage import DriverFiles, delete_paths, list_tree, top_folders

REPORTS = "_cleanup_reports"


@dataclass
class CleanupResult:
    status: str
    plan: DataFrame | None = None
    results: DataFrame | None = None
    totals: DataFrame | None = None
    rejected: DataFrame | None = None


def execute(plan: DataFrame, dry_run: bool, tree: DataFrame | None = None, written: bool = False) -> DataFrame:
    """RESULT rows for every planned folder. A dry run touches nothing.

    The plan must not be derived again from folders that are disappearing, so it is written first
    unless it is ``written`` already. With a listing (a written table too), files are deleted one by
    one all over the cluster before their folders, so that one very large backup is not one task's
    work. A path outside its location is refused.
    """
    columns = ["location", "folder_name", "full_path", "size_bytes", "age_days", "ts"]
    planned = plan.where("reason IS NOT NULL").select(*columns)
    planned = planned if written else settle(planned, "plan")
    if dry_run:
        return planned.select("*", F.lit(True).alias("would_delete"), F.lit(False).alias("deleted"),
                              F.lit(None).cast("string").alias("error"), F.lit(True).alias("dry_run"), F.lit(False).alias("already_gone"))
    inside = (F.col("full_path") == F.concat_ws("/", "location", "folder_name")) & F.startswith("folder_name", F.lit(names.PREFIX))
    targets = planned.where(inside & ~F.contains("full_path", F.lit("/../"))).withColumnRenamed("full_path", "path")
    keys = ["location", "folder_name"]
    locations = [row.location for row in planned.select("location").distinct().collect()]
    if tree is not None:
        files = tree.where("NOT is_dir AND error IS NULL").join(targets.select(*keys), keys, "left_semi").select(*keys, "path")
        delete_paths(files, folders=False, label="deleted-files", locations=locations)
    gone = delete_paths(targets.select(*keys, "path"), folders=True, label="deleted", locations=locations)
    outcome = gone.select(*keys, F.col("error").alias("_error"), "already_gone", F.lit(True).alias("_tried"))
    joined = planned.join(outcome, keys, "left")
    error = F.when(F.col("_tried").isNull(), F.lit("refused: not a backup folder of its location")).otherwise(F.col("_error"))
    there = ~F.coalesce("already_gone", F.lit(False))
    return joined.select(*columns, F.lit(True).alias("would_delete"), (error.isNull() & there).alias("deleted"),
                         error.alias("error"), F.lit(False).alias("dry_run"), (~there).alias("already_gone"))


def write_reports(plan: DataFrame, results: DataFrame, location: str, as_of: dt.datetime, options: CleanupOptions) -> None:
    """Summary as JSON; inventory and deletion results appended to tables partitioned by report time."""
    base = f"{location.rstrip('/')}/{REPORTS}"
    stamp = as_of.strftime("%Y%m%d_%H%M%S")
    here = F.col("location") == location.rstrip("/")
    clock = periods.as_of_column(as_of)
    analysis.report(plan.where(here), clock, options.retention.mode, options.retention.preserve.policy, options.dry_run,
                    ["location"]).coalesce(1).write.mode("overwrite").json(f"{base}/cleanup_report_{stamp}")
    for rows, name in ((analysis.inventory(plan.where(here)), "discovered_backups"), (results.where(here), "deletion_results")):
        rows.withColumn("report_ts", F.lit(stamp)).write.mode("append").partitionBy("report_ts").parquet(f"{base}/{name}")


def cleanup(spark: SparkSession, locations: list[str], options: CleanupOptions, as_of: dt.datetime | None = None) -> CleanupResult:
    """Clean up many locations in one run; every location is planned on its own."""
    as_of = as_of or dt.datetime.now()
    locations = [location.rstrip("/") for location in locations]
    missing = [location for location in locations if not DriverFiles(spark).exists(location)]
    if not locations or missing:
        raise ValueError(f"backup locations do not exist: {missing}")
    tree = list_tree(spark, locations)
    catalog, rejected = discover(spark, locations, as_of, options.include_patterns, options.exclude_patterns, tree)
    # Chains are read off all manifests, before any pattern or name has left a folder out.
    planned = plan_deletions(catalog.drop("manifest"), options.retention)
    plan = settle(without_needed(planned, all_manifests(spark, locations, top_folders(tree))), "plan")
    results = settle(execute(plan, options.dry_run, tree, written=True), "results")
    totals = analysis.operation_totals(results, ["location"])
    if options.write_report:
        reports = per_table(spark, locations, lambda at: write_reports(plan, results, at, as_of, options) or {}, parallel=4)
        for report in reports:
            if report["error"]:
                raise RuntimeError(f"report for {report['table_name']}: {report['error']}")
    planned, failed = results.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())).first()
    status = "success" if failed == 0 else "failed" if failed == planned else "partial_success"
    return CleanupResult("warning" if plan.isEmpty() else status, plan, results, totals, rejected)
