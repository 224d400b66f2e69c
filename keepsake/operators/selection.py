"""Which tables a job works on: explicit lists, manifests, folder scans, filters, settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import names, patterns
from keepsake.options import ENVIRONMENTS


def tables_to_restore(requests: DataFrame, explicit: str, manifest: str, scanned: str) -> DataFrame:
    """One row per table to restore: the explicit list if it names any, else the manifest, else the scan.

    ``explicit`` is comma-separated text, the others arrays. Hidden names are dropped from scans.
    """
    wanted = patterns.parse_list_column(F.col(explicit))
    visible = F.filter(F.col(scanned), lambda name: ~names.is_hidden(name))
    source = (F.when(F.size(wanted) > 0, F.lit("explicit")).when(F.col(manifest).isNotNull(), F.lit("manifest"))
              .otherwise(F.lit("scan")))
    chosen = (F.when(F.col("origin") == "explicit", wanted).when(F.col("origin") == "manifest", F.col(manifest))
              .otherwise(visible))
    rows = requests.withColumn("origin", source).withColumn("table_name", F.explode(chosen))
    return rows.drop(explicit, manifest, scanned)


def explicit_list(text: str) -> list[str]:
    return patterns.parse_list(text)


def filtered(tables: DataFrame, lakehouses: DataFrame, on: str = "lakehouse") -> DataFrame:
    """Tables that match the comma-separated patterns of their lakehouse (columns name, tableFilter)."""
    rules = lakehouses.select(F.col("name").alias(on), patterns.parse_list_column(F.col("tableFilter")).alias("_p"), "workspaceId")
    return tables.join(rules, on).where(patterns.matches_any_column(F.col("table_name"), F.col("_p"))).drop("_p")


def environment_settings(spark: SparkSession, settings: dict | None = None) -> DataFrame:
    """One row per environment, from a map of structs."""
    schema = "map<string,struct<backupMode:string,retentionDays:int,cleanupEnabled:boolean,preservePolicy:string>>"
    text = json.dumps(settings or ENVIRONMENTS)
    parsed = spark.range(1).select(F.from_json(F.lit(text), schema).alias("m"))
    rows = parsed.select(F.explode("m").alias("environment", "s"))
    return rows.select("environment", "s.*")


def with_settings(lakehouses: DataFrame, settings: DataFrame, base: Column) -> DataFrame:
    """Every lakehouse with the settings of its environment and its backup location.

    ``settings`` has one row per environment of a configuration file.
    """
    joined = lakehouses.join(settings, "environment", "left")
    return joined.withColumn("backup_location", names.join_path(base, F.col("name")))
