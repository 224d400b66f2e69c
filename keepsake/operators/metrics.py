"""Operational metrics over a run log: rates, percentiles, latest values, anomalies, forecasts."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import measures, periods
from keepsake.operators.cutoff import Bucket, Key, find_crossing, join_groups
from keepsake.operators.running import prior_sums, prior_value
from keepsake.session import settle

# Metric name -> (window, warning, critical); durations in minutes.
THRESHOLDS = {
    "pipeline_success_rate": ("24 hours", 95.0, 90.0),
    "backup_duration": ("24 hours", 90.0, 120.0),
    "circuit_breaker_trips": ("24 hours", 3.0, 5.0),
    "security_risk_score": ("24 hours", 5.0, 8.0),
    "data_quality_score": ("24 hours", 95.0, 90.0),
    "storage_utilization": ("1 hour", 80.0, 90.0),
    "retry_rate": ("24 hours", 10.0, 20.0),
}


def metric_severity(metric: str, value: Column) -> Column:
    _, warning, critical = THRESHOLDS[metric]
    return measures.severity(value, F.lit(warning), F.lit(critical))


def success_rate(failed: Column) -> Column:
    return F.count_if(~failed) * 100.0 / F.count(F.lit(1))


def share(condition: Column) -> Column:
    return F.count_if(condition) * 100.0 / F.count(F.lit(1))


def run_metrics(runs: DataFrame, keys: list[str], window: str = "24 hours") -> DataFrame:
    """Success rate, retry rate and failure count per window and group, with severities."""
    sums = runs.groupBy(F.window("ts", window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(success_rate(F.col("status") == "Failed"), 6).alias("pipeline_success_rate"),
        F.round(share(F.col("retries") > 0), 6).alias("retry_rate"),
        F.count_if(F.col("status") == "Failed").alias("circuit_breaker_trips"),
    )
    return sums.select(
        F.col("w.start").alias("window_start"), *keys, "runs", "pipeline_success_rate", "retry_rate",
        "circuit_breaker_trips",
        metric_severity("pipeline_success_rate", F.col("pipeline_success_rate")).alias("success_severity"),
        metric_severity("retry_rate", F.col("retry_rate")).alias("retry_severity"),
        metric_severity("circuit_breaker_trips", F.col("circuit_breaker_trips")).alias("trips_severity"),
    )


# How a metric is aggregated where its definition does not say.
AGGREGATIONS = {"pipeline_success_rate": "average", "retry_rate": "average", "circuit_breaker_trips": "sum", "backup_duration": "percentile_95",
                "security_risk_score": "average", "data_quality_score": "average", "storage_utilization": "latest"}


def run_values() -> dict[str, Column]:
    """What one run contributes to the metrics that a run log alone can tell; durations in seconds."""
    percent = lambda met: F.when(met, 100.0).otherwise(0.0)
    return {"pipeline_success_rate": percent(F.col("status") != "Failed"), "retry_rate": percent(F.col("retries") > 0),
            "circuit_breaker_trips": F.when(F.col("status") == "Failed", 1.0).otherwise(0.0), "backup_duration": F.col("duration_min") * 60}


def aggregated(rows: DataFrame, keys: list[str], value: str, aggregation: str, order: list[str]) -> DataFrame:
    """``keys, value``: an aggregation by its name: average, sum, count, minimum, maximum, latest (by ``order``) or percentile_<n>."""
    plain = {"average": F.avg(value), "sum": F.sum(value), "count": F.count(value).cast("double"), "minimum": F.min(value), "maximum": F.max(value),
             "latest": F.max_by(value, F.struct(*order))}
    if aggregation in plain:
        return rows.groupBy(*keys).agg(plain[aggregation].alias(value))
    name, _, share_below = aggregation.partition("_")
    if name != "percentile" or not share_below.isdigit() or not 0 <= int(share_below) <= 100:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    return exact_percentile(rows, keys, value, int(share_below) / 100, value)


def metrics_from_rules(runs: DataFrame, keys: list[str], rules: DataFrame, values: dict[str, Column] | None = None, tie: str = "execution_id") -> DataFrame:
    """``window_start, keys, metric, value, severity`` of the metrics that ``rules`` define.

    Windows, aggregations and thresholds come from the rules table (name, aggregation, window_seconds, warning,
    critical), which has the size of its configuration file and is read on the driver. ``values`` adds what a run
    contributes to further metrics. Rules for metrics without values give no rows; an unknown aggregation raises.
    """
    offered = run_values() | (values or {})
    parts = []
    for rule in rules.where(F.col("name").isin(*offered)).dropDuplicates(["name"]).collect():
        width = F.lit(rule.window_seconds * 1_000_000)
        start = periods.from_epoch_us(periods.epoch_us(F.col("ts")) - F.pmod(periods.epoch_us(F.col("ts")), width))
        rows = runs.select(start.alias("window_start"), *keys, offered[rule.name].cast("double").alias("value"), "ts", tie)
        how = rule["aggregation"] or AGGREGATIONS.get(rule.name, "average")
        sums = aggregated(rows, ["window_start", *keys], "value", how, ["ts", tie]).withColumn("value", F.round("value", 6))
        parts.append(sums.select("window_start", *keys, F.lit(rule.name).alias("metric"), "value",
                                 measures.severity(F.col("value"), F.lit(rule.warning), F.lit(rule.critical)).alias("severity")))
    if not parts:
        raise ValueError("no rule defines a metric of this engine")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def average_score(scores: DataFrame, keys: list[str], score: Column, metric: str) -> DataFrame:
    window, _, _ = THRESHOLDS[metric]
    sums = scores.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.round(F.avg(score), 8).alias(metric))
    return sums.select(F.col("w.start").alias("window_start"), *keys, metric,
                       metric_severity(metric, F.col(metric)).alias("severity"))


def latest(values: DataFrame, keys: list[str], value: str, tie: str, window: str = "1 hour") -> DataFrame:
    """Last value per window and group; equal times are decided by ``tie``."""
    last = values.groupBy(F.window("ts", window).alias("w"), *keys).agg(
        F.max_by(value, F.struct("ts", tie)).alias(value))
    return last.select(F.col("w.start").alias("window_start"), *keys, value)


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share_below: float, name: str,
                     buckets: list[Bucket] | None = None) -> DataFrame:
    """Interpolated percentile per group, exact at any group size; null for a group of nulls.

    Equal values are counted before the shuffle, and the two neighbours of the wanted rank are
    found by bucket totals over ever finer ranges of the value, so no task holds all values of a group.
    """
    number = F.col(value).cast("double")
    counts = settle(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    known = counts.where(F.col(value).isNotNull())
    # A finer range lies within a coarser one: 1, then 1/1024 and 1/1048576 of a unit.
    buckets = buckets or [Bucket(F.floor(number / 1024)), Bucket(F.floor(number)), Bucket(F.floor(number * 1024)), Bucket(F.floor(number * 1048576))]

    def position(total: Column) -> Column:
        return (total - 1) * F.lit(share_below)

    def at(rank) -> DataFrame:
        return find_crossing(known, keys, [Key(value)], buckets, weight=F.col("_n"), budget=rank)

    low = at(lambda total: F.floor(position(total)).cast("bigint") + 1)
    high = at(lambda total: F.ceil(position(total)).cast("bigint") + 1)
    totals = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))), F.lit(0)).alias("_n"))
    part = position(F.col("_n")) - F.floor(position(F.col("_n")))
    found = join_groups(totals, low.select(*keys, F.col(f"cut_{value}").alias("_low")), keys, "left")
    found = join_groups(found, high.select(*keys, F.col(f"cut_{value}").alias("_high")), keys, "left")
    return found.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(name))


def duration_anomalies(runs: DataFrame, keys: list[str], seconds: Column, limit_seconds: int = 7200,
                       deviations: float = 2.0) -> DataFrame:
    """Runs over the limit, or over mean + 2 standard deviations of all earlier runs of the group.

    At least two earlier runs are needed for the second test. Whole seconds keep the sums exact.
    """
    rows = runs.withColumn("seconds", seconds.cast("bigint"))
    exact = F.col("seconds").cast("decimal(20,0)")
    history = prior_sums(
        rows, keys, ["ts", "execution_id"], [periods.day_key(F.col("ts")), periods.epoch_second(F.col("ts"))],
        {"runs": F.lit(1).cast("bigint"), "seconds": F.col("seconds"), "squares": (exact * exact).cast("decimal(38,0)")})
    n = F.col("prior_runs").cast("double")
    mean = F.col("prior_seconds") / F.nullif(n, F.lit(0.0))
    spread = (F.col("prior_squares") * F.col("prior_runs") - F.col("prior_seconds").cast("decimal(19,0)") * F.col("prior_seconds").cast("decimal(19,0)")).cast("double")
    deviation = F.sqrt(spread / F.nullif(n * (n - 1), F.lit(0.0)))
    over_baseline = F.coalesce((F.col("prior_runs") >= 2) & (F.col("seconds") > mean + deviations * deviation), F.lit(False))
    over_limit = F.col("seconds") > limit_seconds
    return history.select("*", over_limit.alias("over_limit"), over_baseline.alias("over_baseline"),
                          (over_limit | over_baseline).alias("alert"))


def size_growth(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Size change against the previous backup of the same group."""
    rows = prior_value(catalog, keys, ["ts", "folder_name"], [periods.day_key(F.col("ts")), periods.epoch_second(F.col("ts"))],
                       "size_bytes", "previous_bytes")
    return rows.withColumn("growth_bytes", F.col("size_bytes") - F.col("previous_bytes"))


def counts_by(events: DataFrame, columns: dict[str, Column], since: Column) -> DataFrame:
    """Event counts by category since a time (pie and heat-map tables)."""
    return events.where(F.col("ts") >= since).groupBy(
        *[column.alias(name) for name, column in columns.items()]).agg(F.count(F.lit(1)).alias("n"))


def student_quantile(freedom: Column, z: float) -> Column:
    """Quantile of Student's distribution where the normal one has ``z``: exact for one and two degrees of freedom, else the
    normal quantile's expansion in 1 / freedom (0.2 % too small at three, 0.01 % at six)."""
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    p = statistics.NormalDist().cdf(z)
    series = F.lit(z)
    for power, term in enumerate(terms, 1):
        series = series + F.lit(term) / F.pow(freedom, F.lit(float(power)))
    return (F.when(freedom == 1, F.lit(math.tan(math.pi * (p - 0.5)))).when(freedom == 2, F.lit((2 * p - 1) / math.sqrt(2 * p * (1 - p))))
            .when(freedom > 2, series))


def forecast(daily: DataFrame, keys: list[str], value: str, horizon_days: int = 90, z: float = 1.96) -> DataFrame:
    """Linear trend per series over day numbers, projected past the last day, with the interval that holds a
    new day's value as surely as ``z`` normal deviations would.

    The interval widens with the distance from the mean day and with few days; null below three days.
    """
    x, y = F.col("day_number").cast("double"), F.col(value).cast("double")
    fit = daily.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.regr_avgx(y, x).alias("_mean"),
        F.count(F.lit(1)).alias("days"), F.max("day_number").alias("_last"))
    day = F.col("_last") + horizon_days
    at = F.col("intercept") + F.col("slope") * day
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    freedom = F.nullif(F.col("days") - 2, F.lit(0)).cast("double")
    away = F.lit(1.0) + F.lit(1.0) / F.col("days") + (day - F.col("_mean")) * (day - F.col("_mean")) / F.col("_sxx")
    error = student_quantile(freedom, z) * F.sqrt(rest / freedom * away)
    return fit.select(*keys, "days", "slope", "intercept", at.alias("forecast"), (at - error).alias("lower"), (at + error).alias("upper"))
