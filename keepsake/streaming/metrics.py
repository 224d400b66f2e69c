"""Windowed metrics and deduplication of event streams. Watermark: one hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import periods
from keepsake.operators.metrics import metric_severity, share, success_rate

WATERMARK = "1 hour"


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", periods.event_time(periods.epoch_us(F.col("ts")))).withWatermark("event_time", WATERMARK)


#: The p95 of a window of n runs is a run whose rank is off by n / PRECISION at most; exact up to PRECISION runs.
PRECISION = 10_000


def tumbling_metrics(runs: DataFrame, keys: list[str], window: str = "24 hours", precision: int = PRECISION) -> DataFrame:
    """Success rate, retry rate, failures, p95 and last utilisation per closed window.

    The percentile's state is a sketch of quantiles that partial aggregates merge; ``precision`` bounds its size and
    its error in ranks.
    """
    failed = F.col("status") == "Failed"
    sums = with_event_time(runs).groupBy(F.window("event_time", window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("runs"), F.round(success_rate(failed), 6).alias("pipeline_success_rate"),
        F.round(share(F.col("retries") > 0), 6).alias("retry_rate"), F.count_if(failed).alias("circuit_breaker_trips"),
        F.percentile_approx("duration_min", 0.95, precision).alias("p95_min"),
        F.max_by("duration_min", F.struct("ts", "execution_id")).alias("last_duration_min"))
    return sums.select(
        periods.from_epoch_us(F.unix_micros("w.start")).alias("window_start"), *keys, "runs", "pipeline_success_rate", "retry_rate",
        "circuit_breaker_trips", "p95_min", "last_duration_min",
        metric_severity("pipeline_success_rate", F.col("pipeline_success_rate")).alias("severity"))


def without_duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """Drop events posted again within the watermark."""
    return with_event_time(events).dropDuplicatesWithinWatermark(keys).drop("event_time")
