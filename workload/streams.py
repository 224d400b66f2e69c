"""The event table as a stream, run to its end; results are those of closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators.alerts import match_rules
from keepsake.streaming import alerts, metrics
from keepsake.streaming.sources import drain, event_stream
from workload.fixtures import RUNS_SQL, runs_from
from workload.monitoring import alert_rules, object_fields, rule_fields, throttled_rules


def _runs(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return runs_from(event_stream(spark, sf_dir, schema, "events.parquet"))


def stream_metrics(spark, sf_dir):
    """Windows of fewer runs than the sketch's precision have their exact p95."""
    return drain(metrics.tumbling_metrics(_runs(spark, sf_dir), ["environment"]), "metrics")


def stream_alerts(spark, sf_dir):
    hits = match_rules(_runs(spark, sf_dir).drop("rule_name"), rule_fields(), alert_rules(spark))
    return drain(hits.select("execution_id", "ts", "environment", "rule_name", "severity"), "alerts")


def stream_throttled(spark, sf_dir):
    return drain(alerts.throttled(_runs(spark, sf_dir), "rule_name", "execution_id"), "throttled")


def stream_throttled_by_rule(spark, sf_dir):
    """Rules in object form on the stream, each throttled as it says; the others pass."""
    runs = _runs(spark, sf_dir).withColumnRenamed("rule_name", "kind")
    hits = match_rules(runs, object_fields(), throttled_rules(spark))
    return drain(alerts.throttled_by_rule(hits, "execution_id"), "throttled_by_rule")


def stream_escalated(spark, sf_dir):
    return drain(alerts.escalated(_runs(spark, sf_dir), "environment", "execution_id",
                                  F.col("rule_name") == "error", F.col("rule_name") == "purchase"), "escalated")


def stream_deduplicated(spark, sf_dir):
    """Every event posted three times."""
    posted = _runs(spark, sf_dir).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    once = metrics.without_duplicates(posted, ["execution_id", "rule_name"])
    return drain(once.select("execution_id", "rule_name", "ts"), "once")


def stream_log(spark, sf_dir):
    rows = _runs(spark, sf_dir).select(
        "ts", F.when(F.col("status") == "Failed", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.concat_ws(" ", F.lit("run"), F.col("execution_id").cast("string"), F.col("status")).alias("message"))
    return drain(rows, "log")


QUERIES = {
    "stream_metrics": stream_metrics,
    "stream_alerts": stream_alerts,
    "stream_throttled": stream_throttled,
    "stream_throttled_by_rule": stream_throttled_by_rule,
    "stream_escalated": stream_escalated,
    "stream_deduplicated": stream_deduplicated,
    "stream_log": stream_log,
}

_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

ORACLES = {
    "stream_metrics": f"""WITH {RUNS_SQL}, m AS (
  SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, environment, count(*) AS runs,
    round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'Success') / count(*), 6) AS pipeline_success_rate,
    round(100.0::DOUBLE * count(*) FILTER (WHERE retries > 0) / count(*), 6) AS retry_rate,
    count(*) FILTER (WHERE status = 'Failed') AS circuit_breaker_trips, quantile_disc(duration_min, 0.95) AS p95_min,
    arg_max(duration_min, (ts, execution_id)) AS last_duration_min FROM runs GROUP BY ALL)
SELECT *, CASE WHEN pipeline_success_rate <= 90 THEN 'critical' WHEN pipeline_success_rate <= 95 THEN 'warning' ELSE 'ok' END AS severity
FROM m WHERE window_start + INTERVAL 1 DAY <= {_MARK}""",
    "stream_alerts": f"""WITH {RUNS_SQL}
SELECT execution_id, ts, environment, 'Backup Failure Alert' AS rule_name, 'High' AS severity FROM runs
  WHERE status = 'Failed' AND environment IN ('staging', 'production')
UNION ALL SELECT execution_id, ts, environment, 'Backup Duration Alert', 'Medium' FROM runs
  WHERE duration_min > 120 AND environment = 'production'
UNION ALL SELECT execution_id, ts, environment, 'Storage Quota Alert', 'High' FROM runs
  WHERE round(duration_min % 100, 2) > 80 AND environment = 'production'""",
    "stream_throttled": f"""WITH {RUNS_SQL}, w AS (
  SELECT rule_name, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, ts, execution_id FROM runs),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_name, window_start ORDER BY ts, execution_id) AS rn FROM w)
SELECT rule_name, window_start, ts, execution_id FROM r WHERE rn <= 3 AND window_start + INTERVAL 15 MINUTE < {_MARK}""",
    "stream_throttled_by_rule": f"""WITH {RUNS_SQL}, h AS (
  SELECT 'Pipeline Execution Failure' AS rule_name, 15 AS minutes, 3 AS most, ts, execution_id FROM runs WHERE rule_name IN ('click', 'error') AND status = 'Failed'
  UNION ALL SELECT 'Storage Space Warning', 60, 2, ts, execution_id FROM runs WHERE round(duration_min % 100, 2) >= 85),
w AS (SELECT *, time_bucket(to_minutes(minutes), ts, TIMESTAMP '1970-01-01') AS window_start FROM h),
r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY rule_name, window_start ORDER BY ts, execution_id) <= most)
SELECT rule_name, window_start, ts, execution_id FROM r WHERE epoch_ms(window_start) + minutes * 60000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM r)
UNION ALL SELECT 'Backup Duration Anomaly', NULL, ts, execution_id FROM runs WHERE rule_name = 'purchase' AND duration_min * 60 > 7200""",
    "stream_escalated": f"""WITH {RUNS_SQL}
SELECT environment, execution_id, ts FROM runs o WHERE rule_name = 'error' AND NOT EXISTS (
  SELECT 1 FROM runs c WHERE c.rule_name = 'purchase' AND c.environment = o.environment
    AND c.ts >= o.ts AND c.ts <= o.ts + INTERVAL 30 MINUTE)
  AND time_bucket(INTERVAL 30 MINUTE, o.ts, TIMESTAMP '1970-01-01') + INTERVAL 60 MINUTE
    < (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('error', 'purchase'))""",
    "stream_deduplicated": "SELECT event_id AS execution_id, event_type AS rule_name, ts FROM events",
    "stream_log": """SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'run ' || event_id || CASE WHEN event_type = 'error' THEN ' Failed' ELSE ' Success' END AS message FROM events""",
}
