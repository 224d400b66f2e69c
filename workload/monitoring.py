"""Metrics, alerts and cost tables over the run log and the star schema."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from keepsake.functions import measures, periods
from keepsake.operators import alerts, costs, metrics
from keepsake.sources import config
from workload.fixtures import CATALOG_SQL, RUNS_SQL, catalog, run_log, table

ENV = ["environment"]
# The run log ends on 2024-01-30; reports are made the day after.
REPORT_DAY = "2024-01-31 00:00:00"
WEEK_AGO = "2024-01-24 00:00:00"


def _cents(column):
    return F.round(F.col(column) * 100).cast("bigint")


def run_metrics(spark, sf_dir):
    return metrics.run_metrics(run_log(spark, sf_dir), ENV)


def duration_p95(spark, sf_dir):
    runs = run_log(spark, sf_dir).withColumn("window_start", F.window("ts", "24 hours")["start"])
    p95 = metrics.exact_percentile(runs, ["window_start", "environment"], "duration_min", 0.95, "p95_min")
    p95 = p95.withColumn("p95_min", F.round("p95_min", 6))
    return p95.withColumn("severity", metrics.metric_severity("backup_duration", F.col("p95_min")))


def quality_score_daily(spark, sf_dir):
    scores = run_log(spark, sf_dir).withColumn("score", F.col("duration_min") / 5)
    return metrics.average_score(scores, ENV, F.col("score"), "data_quality_score")


def risk_score_daily(spark, sf_dir):
    scores = run_log(spark, sf_dir).withColumn("score", F.col("duration_min") / 50)
    daily = metrics.average_score(scores, ENV, F.col("score"), "security_risk_score")
    return daily.withColumn("band", measures.band(F.col("security_risk_score"), measures.RISK_BANDS))


def utilisation_latest(spark, sf_dir):
    values = run_log(spark, sf_dir).withColumn("storage_utilization", F.round(F.col("duration_min") % 100, 2))
    last = metrics.latest(values, ENV, "storage_utilization", "execution_id")
    value = F.col("storage_utilization")
    return last.select("*", metrics.metric_severity("storage_utilization", value).alias("severity"),
                       measures.band(value, measures.STORAGE_BANDS).alias("band"))


def health_bands(spark, sf_dir):
    score = F.col("o_orderkey") % 101
    o = table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"))
    return o.select("*", measures.band(F.col("score"), measures.HEALTH_BANDS).alias("health"),
                    measures.band(F.col("score"), measures.STORAGE_BANDS).alias("storage"),
                    measures.floor_band(F.col("score"), measures.GOVERNANCE_FLOORS, "below").alias("governance"))


# Alert rules in the form of the configuration file.
RULES = [
    {"name": "Backup Failure Alert", "condition": "BackupStatus == 'Failed'", "severity": "High",
     "environments": ["staging", "production"]},
    {"name": "Backup Duration Alert", "condition": "BackupDurationMinutes > 120", "severity": "Medium",
     "environments": ["production"]},
    {"name": "Cleanup Failure Alert", "condition": "CleanupStatus == 'Failed'", "severity": "Medium",
     "environments": ["staging", "production"]},
    {"name": "Storage Quota Alert", "condition": "StorageUsagePercent > 80", "severity": "High",
     "environments": ["production"]},
]


def alert_rules(spark):
    documents = spark.range(1).select(F.lit(json.dumps(RULES)).alias("document"))
    return config.alert_rules(documents)


def rule_fields():
    none = F.lit(None)
    return {
        "BackupStatus": (none, F.col("status")),
        "BackupDurationMinutes": (F.col("duration_min"), none),
        "StorageUsagePercent": (F.round(F.col("duration_min") % 100, 2), none),
    }


def alerts_raised(spark, sf_dir):
    hits = alerts.match_rules(run_log(spark, sf_dir).drop("rule_name"), rule_fields(), alert_rules(spark))
    return hits.select("execution_id", "ts", "environment", "rule_name", "severity")


# Rules and metric definitions in the object form of the configuration file.
OBJECT_RULES = [
    {"name": "Pipeline Execution Failure", "severity": "Critical", "condition": {"eventType": "PipelineCompleted", "status": "Failed"},
     "throttling": {"interval": "PT15M", "maxAlertsPerInterval": 3}},
    {"name": "Backup Duration Anomaly", "severity": "Medium", "condition": {"eventType": "BackupCompleted", "duration": {"operator": ">", "value": "PT2H"}}},
    {"name": "Storage Space Warning", "severity": "Medium", "condition": {"metric": "storage_utilization_percentage", "operator": ">=", "value": 85}},
    {"name": "Data Quality Issues", "severity": "Medium", "condition": {"eventType": "DataQualityCheckCompleted", "qualityScore": {"operator": "<", "value": 0.95}}},
    {"name": "Security Scan High Risk", "severity": "High", "condition": {"eventType": "SecurityScanCompleted", "riskScore": {"operator": ">=", "value": 8.0}}},
]
METRIC_RULES = [
    {"name": "pipeline_success_rate", "timeWindow": "PT24H", "threshold": {"warning": "95", "critical": "90"}},
    {"name": "circuit_breaker_trips", "timeWindow": "PT24H", "threshold": {"warning": "3", "critical": "5"}},
    {"name": "retry_rate", "timeWindow": "PT24H", "threshold": {"warning": "10", "critical": "20"}},
]
EVENT_TYPES = {"click": "PipelineCompleted", "error": "PipelineCompleted", "purchase": "BackupCompleted", "signup": "DataQualityCheckCompleted"}


def _documents(spark, rules):
    return spark.range(1).select(F.lit(json.dumps(rules)).alias("document"))


def object_fields():
    none = F.lit(None)
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in EVENT_TYPES.items()], F.lit("HealthCheckCompleted"))
    return {"eventType": (none, kind), "status": (none, F.col("status")), "duration": (F.col("duration_min") * 60, none),
            "storage_utilization_percentage": (F.round(F.col("duration_min") % 100, 2), none), "qualityScore": (F.col("duration_min") / 400, none)}


def structured_alerts(spark, sf_dir):
    """Rules in object form with several conditions each, throttled as each rule says."""
    runs = run_log(spark, sf_dir).withColumnRenamed("rule_name", "kind")
    hits = alerts.match_rules(runs, object_fields(), config.alert_rules(_documents(spark, OBJECT_RULES)))
    largest = alerts.largest_limit(config.alert_rules(_documents(spark, OBJECT_RULES)))
    return alerts.throttle_by_rule(hits, ["ts", "execution_id"], largest).select("execution_id", "ts", "environment", "rule_name", "severity")


def throttled_rules(spark):
    """Two rules of the configuration with windows and limits of their own, and one without."""
    limits = {"Pipeline Execution Failure": ("PT15M", 3), "Storage Space Warning": ("PT1H", 2), "Backup Duration Anomaly": None}
    rules = [{**rule, "throttling": limits[rule["name"]] and dict(zip(("interval", "maxAlertsPerInterval"), limits[rule["name"]]))}
             for rule in OBJECT_RULES if rule["name"] in limits]
    return config.alert_rules(_documents(spark, rules))


def escalated_by_rule(spark, sf_dir):
    """Hits of three rules that escalate after half an hour, after two hours, and never, unless a purchase of their environment closes them."""
    after = {"Pipeline Execution Failure": "PT30M", "Storage Space Warning": "PT2H", "Data Quality Issues": None}
    rules = config.alert_rules(_documents(spark, [{**rule, "escalation": {"enabled": after[rule["name"]] is not None, "escalateAfter": after[rule["name"]] or "PT5M"}}
                                                  for rule in OBJECT_RULES if rule["name"] in after]))
    runs = run_log(spark, sf_dir).withColumnRenamed("rule_name", "kind")
    hits = alerts.match_rules(runs, object_fields(), rules).select("execution_id", "environment", "ts", "rule_name", "escalate_seconds")
    delays = [row.escalate_seconds for row in rules.where("escalate_seconds IS NOT NULL").select("escalate_seconds").distinct().collect()]
    return alerts.escalate_by_rule(hits, runs.where("kind = 'purchase'").select("environment", "ts"), "environment", delays)


# Metric definitions of the configuration file.
ALL_METRIC_RULES = [
    {"name": "pipeline_success_rate", "type": "percentage", "aggregation": "average", "timeWindow": "PT24H", "threshold": {"warning": 95, "critical": 90}},
    {"name": "backup_duration", "type": "duration", "aggregation": "percentile_95", "timeWindow": "PT24H", "threshold": {"warning": "PT1H30M", "critical": "PT2H"}},
    {"name": "circuit_breaker_trips", "type": "count", "aggregation": "sum", "timeWindow": "PT24H", "threshold": {"warning": 3, "critical": 5}},
    {"name": "security_risk_score", "type": "score", "aggregation": "average", "timeWindow": "PT24H", "threshold": {"warning": 5.0, "critical": 8.0}},
    {"name": "data_quality_score", "type": "percentage", "aggregation": "average", "timeWindow": "PT24H", "threshold": {"warning": 95, "critical": 90}},
    {"name": "storage_utilization", "type": "percentage", "aggregation": "latest", "timeWindow": "PT1H", "threshold": {"warning": 80, "critical": 90}},
    {"name": "retry_rate", "type": "percentage", "aggregation": "average", "timeWindow": "PT24H", "threshold": {"warning": 10, "critical": 20}},
]


def all_metrics_from_rules(spark, sf_dir):
    """All seven metric definitions, each with its own window, aggregation and thresholds."""
    values = {"security_risk_score": F.col("duration_min") / 50, "data_quality_score": F.col("duration_min") / 5,
              "storage_utilization": F.round(F.col("duration_min") % 100, 2)}
    return metrics.metrics_from_rules(run_log(spark, sf_dir), ENV, config.metric_rules(_documents(spark, ALL_METRIC_RULES)), values)


def metrics_from_rules(spark, sf_dir):
    return metrics.metrics_from_rules(run_log(spark, sf_dir), ["environment"], config.metric_rules(_documents(spark, METRIC_RULES)))


def alerts_throttled(spark, sf_dir):
    kept = alerts.throttle(run_log(spark, sf_dir), "rule_name", ["ts", "execution_id"])
    return kept.select("rule_name", "window_start", "ts", "execution_id")


def alerts_escalated(spark, sf_dir):
    runs = run_log(spark, sf_dir)
    opened = runs.where("rule_name = 'error'").select("execution_id", "environment", "ts")
    closed = runs.where("rule_name = 'purchase'").select("environment", "ts")
    return alerts.escalate(opened, closed, "environment")


def duration_anomalies(spark, sf_dir):
    rows = metrics.duration_anomalies(run_log(spark, sf_dir), ENV, F.round(F.col("duration_min") * 60))
    return rows.select("execution_id", "environment", "seconds", "prior_runs", "prior_seconds", "over_limit", "over_baseline", "alert")


def size_growth(spark, sf_dir):
    rows = metrics.size_growth(catalog(spark, sf_dir), ["source_lakehouse"])
    return rows.select("source_lakehouse", "folder_name", "size_bytes", "previous_bytes", "growth_bytes")


def issues_by_category(spark, sf_dir):
    return metrics.counts_by(table(spark, sf_dir, "events"), {"category": F.col("event_type")}, periods.as_of_column(WEEK_AGO))


def access_heat_map(spark, sf_dir):
    return metrics.counts_by(
        table(spark, sf_dir, "events"),
        {"weekday": F.dayofweek(F.col("ts").cast("date")).cast("bigint"), "hour": F.hour("ts").cast("bigint")},
        periods.as_of_column(WEEK_AGO))


_COMPONENTS = {"click": "data_classification_coverage", "view": "lineage_completeness",
               "purchase": "policy_compliance_rate", "signup": "access_control_effectiveness"}


def governance_score(spark, sf_dir):
    component = F.lit(None).cast("string")
    for rule, name in _COMPONENTS.items():
        component = F.when(F.col("rule_name") == rule, F.lit(name)).otherwise(component)
    parts = run_log(spark, sf_dir).groupBy("environment", component.alias("component")).agg(
        F.avg(F.col("duration_min") / 5).alias("value"))
    return costs.governance_score(parts.where("component IS NOT NULL"), ENV)


def compliance_score(spark, sf_dir):
    framework = F.element_at(F.array(*[F.lit(f) for f in costs.FRAMEWORKS]), (F.col("execution_id") % 4 + 1).cast("int"))
    scores = run_log(spark, sf_dir).groupBy(F.col("user_id").alias("lakehouse"), framework.alias("framework")).agg(
        F.round(metrics.success_rate(F.col("status") == "Failed"), 6).alias("score"))
    return costs.compliance_score(scores, ["lakehouse"])


def cost_efficiency(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("month", periods.month_key(F.col("ts")))
    return costs.cost_efficiency(rows, ["location", "month"], F.col("size_bytes"), F.col("age_days") % 10)


def optimisation_potential(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    saved = _cents("l_extendedprice") * F.round(F.col("l_discount") * 100).cast("bigint")
    weight = F.when(F.col("l_suppkey") % 3 == 0, F.lit(4)).when(F.col("l_suppkey") % 3 == 1, F.lit(2)).otherwise(F.lit(1))
    return costs.optimisation_potential(lines, ["l_suppkey"], saved * weight, _cents("l_extendedprice") * 100)


def top_savings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    saved = _cents("l_extendedprice") * F.round(F.col("l_discount") * 100).cast("bigint")
    return costs.top_savings(lines, "l_partkey", _cents("l_extendedprice") * 100, saved)


def _spend(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("owner"), F.col("o_orderdate").alias("ts"), _cents("o_totalprice").alias("cost"))


def _budget(unit, threshold, periods_in_log):
    def query(spark, sf_dir):
        spend = _spend(spark, sf_dir)
        budgets = spend.groupBy("owner").agg(F.floor(F.sum("cost") / periods_in_log).cast("bigint").alias("budget"))
        return costs.budget_alerts(spend, budgets, ["owner"], unit, threshold)
    return query


def monthly_cost_trend(spark, sf_dir):
    kind = (F.when(F.col("l_returnflag") == "A", F.lit("backup")).when(F.col("l_returnflag") == "N", F.lit("storage"))
            .otherwise(F.lit("compute")))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"), kind.alias("cost_type"), _cents("l_extendedprice").alias("cost"))
    return costs.monthly_trend(rows, ["backup", "storage", "compute"], periods.as_of_column("2000-08-01 00:00:00"))


def capacity_forecast(spark, sf_dir):
    daily = catalog(spark, sf_dir).groupBy(
        "source_lakehouse", F.datediff(F.col("ts").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("day_number")).agg(
        measures.size_gb(F.sum("size_bytes")).alias("gb"))
    line = metrics.forecast(daily, ["source_lakehouse"], "gb")
    return line.select("source_lakehouse", "days", *[F.round(c, 3).alias(c) for c in ("slope", "intercept", "forecast", "lower", "upper")])


QUERIES = {
    "run_metrics": run_metrics,
    "duration_p95": duration_p95,
    "quality_score_daily": quality_score_daily,
    "risk_score_daily": risk_score_daily,
    "utilisation_latest": utilisation_latest,
    "health_bands": health_bands,
    "alerts_raised": alerts_raised,
    "alerts_throttled": alerts_throttled,
    "alerts_escalated": alerts_escalated,
    "escalated_by_rule": escalated_by_rule,
    "all_metrics_from_rules": all_metrics_from_rules,
    "duration_anomalies": duration_anomalies,
    "size_growth": size_growth,
    "structured_alerts": structured_alerts,
    "metrics_from_rules": metrics_from_rules,
    "issues_by_category": issues_by_category,
    "access_heat_map": access_heat_map,
    "governance_score": governance_score,
    "compliance_score": compliance_score,
    "cost_efficiency": cost_efficiency,
    "optimisation_potential": optimisation_potential,
    "top_savings": top_savings,
    "budget_monthly": _budget("month", 80, 80),
    "budget_quarterly": _budget("quarter", 90, 27),
    "monthly_cost_trend": monthly_cost_trend,
    "capacity_forecast": capacity_forecast,
}

_DAY = "time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')"
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_SAVED = f"{_CENTS} * CAST(round(l_discount * 100) AS BIGINT)"


def _budget_sql(unit, threshold, periods_in_log):
    return f"""WITH s AS (SELECT o_orderpriority AS owner, CAST(round(o_totalprice * 100) AS BIGINT) AS cost,
  strftime(date_trunc('{unit}', o_orderdate), '%Y-%m-%d') AS period FROM orders),
b AS (SELECT owner, CAST(floor(CAST(sum(cost) AS BIGINT) / {periods_in_log}) AS BIGINT) AS budget FROM s GROUP BY owner),
p AS (SELECT owner, period, CAST(sum(cost) AS BIGINT) AS spend FROM s GROUP BY ALL)
SELECT owner, period, spend, budget, round(spend * 100.0::DOUBLE / budget, 6) AS used_percent,
  spend * 100.0::DOUBLE / budget >= {threshold} AS alert FROM p JOIN b USING (owner)"""


ORACLES = {
    "run_metrics": f"""WITH {RUNS_SQL}, m AS (
  SELECT {_DAY} AS window_start, environment, count(*) AS runs,
    round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'Success') / count(*), 6) AS pipeline_success_rate,
    round(100.0::DOUBLE * count(*) FILTER (WHERE retries > 0) / count(*), 6) AS retry_rate,
    count(*) FILTER (WHERE status = 'Failed') AS circuit_breaker_trips FROM runs GROUP BY ALL)
SELECT *, CASE WHEN pipeline_success_rate <= 90 THEN 'critical' WHEN pipeline_success_rate <= 95 THEN 'warning' ELSE 'ok' END AS success_severity,
  CASE WHEN retry_rate >= 20 THEN 'critical' WHEN retry_rate >= 10 THEN 'warning' ELSE 'ok' END AS retry_severity,
  CASE WHEN circuit_breaker_trips >= 5 THEN 'critical' WHEN circuit_breaker_trips >= 3 THEN 'warning' ELSE 'ok' END AS trips_severity
FROM m""",
    "duration_p95": f"""WITH {RUNS_SQL}, m AS (
  SELECT {_DAY} AS window_start, environment, round(quantile_cont(duration_min, 0.95), 6) AS p95_min FROM runs GROUP BY ALL)
SELECT *, CASE WHEN p95_min >= 120 THEN 'critical' WHEN p95_min >= 90 THEN 'warning' ELSE 'ok' END AS severity FROM m""",
    "quality_score_daily": f"""WITH {RUNS_SQL}, m AS (
  SELECT {_DAY} AS window_start, environment, round(avg(duration_min / 5), 8) AS data_quality_score FROM runs GROUP BY ALL)
SELECT *, CASE WHEN data_quality_score <= 90 THEN 'critical' WHEN data_quality_score <= 95 THEN 'warning' ELSE 'ok' END AS severity FROM m""",
    "risk_score_daily": f"""WITH {RUNS_SQL}, m AS (
  SELECT {_DAY} AS window_start, environment, round(avg(duration_min / 50), 8) AS security_risk_score FROM runs GROUP BY ALL)
SELECT *, CASE WHEN security_risk_score >= 8 THEN 'critical' WHEN security_risk_score >= 5 THEN 'warning' ELSE 'ok' END AS severity,
  CASE WHEN security_risk_score < 3 THEN 'green' WHEN security_risk_score < 6 THEN 'yellow' WHEN security_risk_score < 8 THEN 'orange'
    WHEN security_risk_score <= 10 THEN 'red' END AS band FROM m""",
    "utilisation_latest": f"""WITH {RUNS_SQL}, m AS (
  SELECT date_trunc('hour', ts) AS window_start, environment,
    arg_max(round(duration_min % 100, 2), (ts, execution_id)) AS storage_utilization FROM runs GROUP BY ALL)
SELECT *, CASE WHEN storage_utilization >= 90 THEN 'critical' WHEN storage_utilization >= 80 THEN 'warning' ELSE 'ok' END AS severity,
  CASE WHEN storage_utilization < 70 THEN 'green' WHEN storage_utilization < 85 THEN 'yellow' ELSE 'red' END AS band FROM m""",
    "health_bands": """SELECT o_orderkey, o_orderkey % 101 AS score,
  CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 85 THEN 'good' WHEN score >= 75 THEN 'warning' ELSE 'critical' END AS health,
  CASE WHEN score >= 85 THEN 'red' WHEN score >= 70 THEN 'yellow' ELSE 'green' END AS storage,
  CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'fair' WHEN score >= 60 THEN 'poor'
    ELSE 'below' END AS governance FROM orders""",
    "alerts_raised": f"""WITH {RUNS_SQL}
SELECT execution_id, ts, environment, 'Backup Failure Alert' AS rule_name, 'High' AS severity FROM runs
  WHERE status = 'Failed' AND environment IN ('staging', 'production')
UNION ALL SELECT execution_id, ts, environment, 'Backup Duration Alert', 'Medium' FROM runs
  WHERE duration_min > 120 AND environment = 'production'
UNION ALL SELECT execution_id, ts, environment, 'Storage Quota Alert', 'High' FROM runs
  WHERE round(duration_min % 100, 2) > 80 AND environment = 'production'""",
    "alerts_throttled": f"""WITH {RUNS_SQL}, w AS (
  SELECT rule_name, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, ts, execution_id FROM runs),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_name, window_start ORDER BY ts, execution_id) AS rn FROM w)
SELECT rule_name, window_start, ts, execution_id FROM r WHERE rn <= 3""",
    "escalated_by_rule": f"""WITH {RUNS_SQL}, o AS (
  SELECT execution_id, environment, ts, 'Pipeline Execution Failure' AS rule_name, 1800::BIGINT AS escalate_seconds FROM runs
  WHERE rule_name IN ('click', 'error') AND status = 'Failed'
  UNION ALL SELECT execution_id, environment, ts, 'Storage Space Warning', 7200 FROM runs WHERE round(duration_min % 100, 2) >= 85)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM runs c WHERE c.rule_name = 'purchase' AND c.environment = o.environment
  AND c.ts >= o.ts AND c.ts <= o.ts + to_seconds(escalate_seconds))""",
    "all_metrics_from_rules": f"""WITH {RUNS_SQL}, d AS (
  SELECT {_DAY} AS window_start, environment, avg(CASE WHEN status <> 'Failed' THEN 100.0::DOUBLE ELSE 0 END) AS ok,
    avg(CASE WHEN retries > 0 THEN 100.0::DOUBLE ELSE 0 END) AS again, (count(*) FILTER (WHERE status = 'Failed'))::DOUBLE AS trips,
    quantile_cont(duration_min * 60, 0.95) AS slow, avg(duration_min / 50) AS risk, avg(duration_min / 5) AS quality FROM runs GROUP BY ALL),
h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, environment,
    arg_max(round(duration_min % 100, 2), (ts, execution_id)) AS used FROM runs GROUP BY ALL),
v AS (SELECT window_start, environment, 'pipeline_success_rate' AS metric, ok AS value, 95::DOUBLE AS warning, 90::DOUBLE AS critical FROM d
  UNION ALL SELECT window_start, environment, 'backup_duration', slow, 5400, 7200 FROM d
  UNION ALL SELECT window_start, environment, 'circuit_breaker_trips', trips, 3, 5 FROM d
  UNION ALL SELECT window_start, environment, 'security_risk_score', risk, 5, 8 FROM d
  UNION ALL SELECT window_start, environment, 'data_quality_score', quality, 95, 90 FROM d
  UNION ALL SELECT window_start, environment, 'storage_utilization', used, 80, 90 FROM h
  UNION ALL SELECT window_start, environment, 'retry_rate', again, 10, 20 FROM d),
r AS (SELECT window_start, environment, metric, round(value, 6) AS value, warning, critical FROM v)
SELECT window_start, environment, metric, value, CASE WHEN warning > critical THEN CASE WHEN value <= critical THEN 'critical' WHEN value <= warning THEN 'warning' ELSE 'ok' END
  WHEN value >= critical THEN 'critical' WHEN value >= warning THEN 'warning' ELSE 'ok' END AS severity FROM r""",
    "alerts_escalated": f"""WITH {RUNS_SQL}
SELECT execution_id, environment, ts FROM runs o WHERE rule_name = 'error' AND NOT EXISTS (
  SELECT 1 FROM runs c WHERE c.rule_name = 'purchase' AND c.environment = o.environment
    AND c.ts >= o.ts AND c.ts <= o.ts + INTERVAL 30 MINUTE)""",
    "duration_anomalies": f"""WITH {RUNS_SQL}, s AS (SELECT *, CAST(round(duration_min * 60) AS BIGINT) AS seconds FROM runs),
h AS (SELECT *, count(*) OVER w AS prior_runs, CAST(coalesce(sum(seconds) OVER w, 0) AS BIGINT) AS prior_seconds,
    coalesce(sum(CAST(seconds AS HUGEINT) * seconds) OVER w, 0) AS squares FROM s
  WINDOW w AS (PARTITION BY environment ORDER BY ts, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, CASE WHEN prior_runs >= 2 THEN seconds > prior_seconds / prior_runs::DOUBLE
    + 2 * sqrt((squares * prior_runs - CAST(prior_seconds AS HUGEINT) * prior_seconds)::DOUBLE / (prior_runs::DOUBLE * (prior_runs - 1)))
    ELSE false END AS over_baseline FROM h)
SELECT execution_id, environment, seconds, prior_runs, prior_seconds, seconds > 7200 AS over_limit, over_baseline,
  seconds > 7200 OR over_baseline AS alert FROM d""",
    "size_growth": f"""WITH {CATALOG_SQL}
SELECT source_lakehouse, folder_name, size_bytes, lag(size_bytes) OVER w AS previous_bytes,
  size_bytes - lag(size_bytes) OVER w AS growth_bytes FROM catalog
WINDOW w AS (PARTITION BY source_lakehouse ORDER BY ts, folder_name)""",
    "structured_alerts": f"""WITH {RUNS_SQL}, e AS (
  SELECT *, CASE rule_name WHEN 'click' THEN 'PipelineCompleted' WHEN 'error' THEN 'PipelineCompleted' WHEN 'purchase' THEN 'BackupCompleted'
    WHEN 'signup' THEN 'DataQualityCheckCompleted' ELSE 'HealthCheckCompleted' END AS kind FROM runs),
f AS (SELECT *, row_number() OVER (PARTITION BY time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') ORDER BY ts, execution_id) AS n
  FROM e WHERE kind = 'PipelineCompleted' AND status = 'Failed')
SELECT execution_id, ts, environment, 'Pipeline Execution Failure' AS rule_name, 'Critical' AS severity FROM f WHERE n <= 3
UNION ALL SELECT execution_id, ts, environment, 'Backup Duration Anomaly', 'Medium' FROM e WHERE kind = 'BackupCompleted' AND duration_min * 60 > 7200
UNION ALL SELECT execution_id, ts, environment, 'Storage Space Warning', 'Medium' FROM e WHERE round(duration_min % 100, 2) >= 85
UNION ALL SELECT execution_id, ts, environment, 'Data Quality Issues', 'Medium' FROM e WHERE kind = 'DataQualityCheckCompleted' AND duration_min / 400 < 0.95""",
    "metrics_from_rules": f"""WITH {RUNS_SQL}, m AS (
  SELECT {_DAY} AS window_start, environment,
    round(100.0::DOUBLE * count(*) FILTER (WHERE status <> 'Failed') / count(*), 6) AS ok, round(100.0::DOUBLE * count(*) FILTER (WHERE retries > 0) / count(*), 6) AS again,
    (count(*) FILTER (WHERE status = 'Failed'))::DOUBLE AS trips FROM runs GROUP BY ALL)
SELECT window_start, environment, 'pipeline_success_rate' AS metric, ok AS value, CASE WHEN ok <= 90 THEN 'critical' WHEN ok <= 95 THEN 'warning' ELSE 'ok' END AS severity FROM m
UNION ALL SELECT window_start, environment, 'retry_rate', again, CASE WHEN again >= 20 THEN 'critical' WHEN again >= 10 THEN 'warning' ELSE 'ok' END FROM m
UNION ALL SELECT window_start, environment, 'circuit_breaker_trips', trips, CASE WHEN trips >= 5 THEN 'critical' WHEN trips >= 3 THEN 'warning' ELSE 'ok' END FROM m""",
    "issues_by_category": f"SELECT event_type AS category, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{WEEK_AGO}' GROUP BY ALL",
    "access_heat_map": f"""SELECT dayofweek(ts) + 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '{WEEK_AGO}' GROUP BY ALL""",
    "governance_score": f"""WITH {RUNS_SQL}, c AS (
  SELECT environment, rule_name, avg(duration_min / 5) AS value,
    CASE rule_name WHEN 'click' THEN 0.3::DOUBLE WHEN 'signup' THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END AS weight
  FROM runs WHERE rule_name <> 'error' GROUP BY ALL),
g AS (SELECT environment, round(sum(value * weight) / sum(weight), 8) AS governance_score FROM c GROUP BY ALL)
SELECT *, CASE WHEN governance_score >= 90 THEN 'excellent' WHEN governance_score >= 80 THEN 'good' WHEN governance_score >= 70 THEN 'fair'
  WHEN governance_score >= 60 THEN 'poor' ELSE 'below' END AS band FROM g""",
    "compliance_score": f"""WITH {RUNS_SQL}, s AS (
  SELECT user_id AS lakehouse, execution_id % 4 AS framework,
    round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'Success') / count(*), 6) AS score FROM runs GROUP BY ALL)
SELECT lakehouse, min(score) AS compliance_score, min(score) >= 95 AS compliant FROM s GROUP BY ALL""",
    "cost_efficiency": f"""WITH {CATALOG_SQL}, c AS (
  SELECT location, strftime(ts, '%Y-%m') AS month,
    round(CAST(sum(size_bytes) AS BIGINT) / 1099511627776.0::DOUBLE / nullif(CAST(sum(age_days % 10) AS BIGINT), 0), 6) AS tb_per_cost
  FROM catalog GROUP BY ALL)
SELECT *, coalesce(tb_per_cost > 10, false) AS on_target FROM c""",
    "optimisation_potential": f"""WITH p AS (
  SELECT l_suppkey, round(CAST(sum({_SAVED} * CASE l_suppkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) * 100.0::DOUBLE
    / CAST(sum({_CENTS} * 100) AS BIGINT), 6) AS potential_percent FROM lineitem GROUP BY ALL)
SELECT *, CASE WHEN potential_percent > 20 THEN 'high' WHEN potential_percent >= 10 THEN 'medium' ELSE 'low' END AS potential FROM p""",
    "top_savings": f"""SELECT l_partkey AS resource, CAST(sum({_CENTS} * 100) AS BIGINT) AS current_cost,
  CAST(sum({_SAVED}) AS BIGINT) AS potential_savings, CAST(sum({_CENTS} * 100) - sum({_SAVED}) AS BIGINT) AS optimized_cost
FROM lineitem GROUP BY ALL ORDER BY potential_savings DESC, resource LIMIT 10""",
    "budget_monthly": _budget_sql("month", 80, 80),
    "budget_quarterly": _budget_sql("quarter", 90, 27),
    "monthly_cost_trend": f"""SELECT strftime(l_shipdate, '%Y-%m') AS month,
  CAST(coalesce(sum({_CENTS}) FILTER (WHERE l_returnflag = 'A'), 0) AS BIGINT) AS backup_costs,
  CAST(coalesce(sum({_CENTS}) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS storage_costs,
  CAST(coalesce(sum({_CENTS}) FILTER (WHERE l_returnflag NOT IN ('A', 'N')), 0) AS BIGINT) AS compute_costs
FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-08-01' GROUP BY ALL""",
    "capacity_forecast": f"""WITH {CATALOG_SQL}, d AS (
  SELECT source_lakehouse, date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS x,
    CAST(sum(size_bytes) AS BIGINT) / 1073741824.0::DOUBLE AS y FROM catalog GROUP BY ALL),
m AS (SELECT *, avg(x) OVER (PARTITION BY source_lakehouse) AS mx, avg(y) OVER (PARTITION BY source_lakehouse) AS my FROM d),
f AS (SELECT source_lakehouse, count(*) AS days, min(mx) AS mx, min(my) AS my, nullif(sum((x - mx) * (x - mx)), 0) AS sxx,
    sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy, max(x) + 90 AS x0 FROM m GROUP BY ALL),
t AS (SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, nullif(days - 2, 0)::DOUBLE AS v, 1.96::DOUBLE AS z, 0.9750021048517795::DOUBLE AS p FROM f),
q AS (SELECT *, CASE WHEN v = 1 THEN tan(pi() * (p - 0.5)) WHEN v = 2 THEN (2 * p - 1) / sqrt(2 * p * (1 - p)) WHEN v > 2 THEN
    z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
      + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v**4) END AS student FROM t),
g AS (SELECT *, intercept + slope * x0 AS forecast, student * sqrt(greatest(syy - sxy * sxy / sxx, 0) / v * (1 + 1.0::DOUBLE / days + (x0 - mx) * (x0 - mx) / sxx)) AS err FROM q)
SELECT source_lakehouse, days, round(slope, 3) AS slope, round(intercept, 3) AS intercept, round(forecast, 3) AS forecast,
  round(forecast - err, 3) AS lower, round(forecast + err, 3) AS upper FROM g""",
}
