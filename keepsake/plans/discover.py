"""The catalog of all backups below some locations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import measures, names, patterns, periods
from keepsake.session import settle
from keepsake.sources.manifests import read_manifests
from keepsake.sources.storage import folder_sizes, list_tree


def backup_folders(tree: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Folders directly below each location that pass the patterns, with their parsed time."""
    name = F.col("folder_name")
    return (
        tree.where(F.col("is_dir") & (F.col("path") == F.concat_ws("/", "location", name)) & ~names.is_hidden(name))
        .select("location", "folder_name", F.col("path").alias("full_path")).distinct()
        .where(patterns.selected(name, include, exclude))
        .withColumn("ts", names.folder_timestamp(name))
    )


def discover(spark: SparkSession, locations: list[str], as_of: dt.datetime | str, include: str = "backup_*",
             exclude: str = "", tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, rejected) over all locations in one plan.

    Sizes and manifests are left-joined to the folders, so empty folders and folders without a
    manifest stay in. ``rejected`` holds folders whose name does not parse or that could not be read
    in full; they are never planned for deletion. The catalog is written once and read back.
    """
    tree = list_tree(spark, locations) if tree is None else tree
    folders = backup_folders(tree, patterns.parse_list(include), patterns.parse_list(exclude))
    keys = ["location", "folder_name"]
    manifest = F.col("manifest")
    size = F.coalesce("size_bytes", F.lit(0).cast("bigint"))
    joined = folders.join(folder_sizes(tree), keys, "left").join(read_manifests(spark, locations), keys, "left")
    catalog = joined.select(
        *keys, "full_path", "ts", names.folder_id(F.col("folder_name")).alias("backup_id"),
        size.alias("size_bytes"), measures.size_mb(size).alias("size_mb"), measures.size_gb(size).alias("size_gb"),
        periods.age_days(F.col("ts"), periods.as_of_column(as_of)).alias("age_days"),
        measures.or_unknown(manifest["source_lakehouse_name"]).alias("source_lakehouse"),
        measures.array_length(manifest["tables"]).alias("tables_count"),
        measures.or_unknown(manifest["backup_type"]).alias("backup_type"),
        manifest.alias("manifest"), F.col("error"),
    )
    catalog = settle(catalog, "catalog")
    rejected = F.col("ts").isNull() | F.col("error").isNotNull()
    reason = F.when(F.col("ts").isNull(), F.lit("name does not parse")).otherwise(F.col("error"))
    return (catalog.where(~rejected).drop("error"),
            catalog.where(rejected).select(*keys, "full_path", reason.alias("reason")))
