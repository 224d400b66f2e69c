"""Configuration documents as small DataFrames: lakehouse lists and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.periods import iso_seconds

LAKEHOUSES = "array<struct<name:string,workspaceId:string,tableFilter:string>>"
# A condition may be a text or an object; either way it is read as text.
ALERT_RULES = ("array<struct<name:string,condition:string,severity:string,environments:array<string>,"
               "throttling:struct<interval:string,maxAlertsPerInterval:int>,escalation:struct<enabled:boolean,escalateAfter:string>>>")
METRICS = ("array<struct<name:string,type:string,aggregation:string,timeWindow:string,"
           "threshold:struct<warning:string,critical:string>>>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one row each, as text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def at(document: Column, pointer: str, schema: str) -> Column:
    """A typed part of a JSON document, by path such as $.monitoringConfiguration.metrics."""
    return F.from_json(F.get_json_object(document, pointer), schema)


def lakehouse_list(documents: DataFrame, pointer: str = "$") -> DataFrame:
    return documents.select(F.explode(at(F.col("document"), pointer, LAKEHOUSES)).alias("l")).select("l.*")


def alert_rules(documents: DataFrame, pointer: str = "$") -> DataFrame:
    """Rules with their own throttling and escalation, null where a rule states none."""
    rules = documents.select(F.explode(at(F.col("document"), pointer, ALERT_RULES)).alias("r")).select("r.*")
    return rules.select(
        F.col("name").alias("rule_name"), "severity", "condition", "environments",
        iso_seconds(F.col("throttling.interval")).alias("throttle_seconds"), F.col("throttling.maxAlertsPerInterval").alias("throttle_most"),
        F.when(F.col("escalation.enabled"), iso_seconds(F.col("escalation.escalateAfter"))).alias("escalate_seconds"))


def metric_rules(documents: DataFrame, pointer: str = "$") -> DataFrame:
    """Metric definitions with their window in seconds and thresholds as numbers (durations in seconds)."""
    def number(text: Column) -> Column:
        return F.coalesce(text.try_cast("double"), iso_seconds(text).cast("double"))

    rules = documents.select(F.explode(at(F.col("document"), pointer, METRICS)).alias("m")).select("m.*")
    return rules.select("name", "type", "aggregation", iso_seconds(F.col("timeWindow")).alias("window_seconds"),
                        number(F.col("threshold.warning")).alias("warning"),
                        number(F.col("threshold.critical")).alias("critical"))
