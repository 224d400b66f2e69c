"""Preservation, retention planning, emergency plan and preview over the backup catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import retention as ret
from keepsake.operators.preservation import preserved_backups, with_preservation
from keepsake.options import PreserveOptions, RetentionOptions
from workload.fixtures import CATALOG_SQL, catalog

# Chosen so that at sf0.01 every stage of the advanced plan deletes some backups and keeps some.
DAYS, COUNT, CAP = 1200, 1500, 30_502_000_000_000
MONTHLY = PreserveOptions("monthly")


def _advanced():
    return RetentionOptions("advanced", DAYS, COUNT, CAP, MONTHLY)


def _plan_columns(plan):
    return plan.select("location", "folder_name", "preserved", "reason")


def retention_summary(spark, sf_dir):
    return ret.plan_summary(ret.plan_deletions(catalog(spark, sf_dir), _advanced()), cap=CAP)


def _preserved(policy):
    def query(spark, sf_dir):
        rows = catalog(spark, sf_dir)
        kept = preserved_backups(rows, PreserveOptions(policy), ["location"])
        return kept.drop("ts")
    return query


def _retention(mode):
    def query(spark, sf_dir):
        preserve = PreserveOptions("weekly") if mode == "size_based" else MONTHLY
        options = RetentionOptions(mode, DAYS, COUNT, CAP, preserve)
        return _plan_columns(ret.plan_deletions(catalog(spark, sf_dir), options))
    return query


def emergency(spark, sf_dir):
    plan = ret.emergency_plan(catalog(spark, sf_dir), CAP)
    return plan.where("selected").select("location", "folder_name", "age_days", "size_bytes")


def emergency_preserving(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    rows = with_preservation(rows, PreserveOptions("daily"))
    plan = ret.emergency_plan(rows, CAP * 10, respect_preservation=True)
    return plan.where("selected").select("location", "folder_name", "size_bytes")


def preview(spark, sf_dir):
    return ret.preview(catalog(spark, sf_dir), {
        "age 400": RetentionOptions("age_based", retention_days=400),
        "age 1200": RetentionOptions("age_based", retention_days=1200),
        "count 1500": RetentionOptions("count_based", max_count=1500),
        "size cap": RetentionOptions("size_based", max_size_bytes=CAP),
    })


def simple(spark, sf_dir):
    return ret.simple_retention(catalog(spark, sf_dir), 365).where("reason IS NOT NULL").select("location", "folder_name")


def newest_backups(spark, sf_dir):
    return ret.newest(catalog(spark, sf_dir), 5).select("location", "position", "folder_name")


def surviving(spark, sf_dir):
    """Catalog minus the planned deletions, by anti join on the plan."""
    rows = catalog(spark, sf_dir)
    plan = ret.plan_deletions(rows, RetentionOptions("age_based", DAYS, preserve=MONTHLY))
    doomed = plan.where("reason IS NOT NULL").select("location", "folder_name")
    left = rows.join(doomed, ["location", "folder_name"], "left_anti")
    return left.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


QUERIES = {
    "retention_summary": retention_summary,
    "preserved_daily": _preserved("daily"),
    "preserved_weekly": _preserved("weekly"),
    "preserved_monthly": _preserved("monthly"),
    "retention_age": _retention("age_based"),
    "retention_count": _retention("count_based"),
    "retention_size": _retention("size_based"),
    "retention_advanced": _retention("advanced"),
    "emergency_plan": emergency,
    "emergency_plan_preserving": emergency_preserving,
    "cleanup_preview": preview,
    "simple_retention": simple,
    "newest_backups": newest_backups,
    "surviving_backups": surviving,
}


def _keyed(level: int) -> str:
    """Catalog with keep flags; ``level`` 1 daily, 2 weekly, 3 monthly, 0 none."""
    return f"""{CATALOG_SQL},
keyed AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-W%U') AS w, strftime(ts, '%Y-%m') AS m FROM catalog
),
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY location, d ORDER BY ts DESC, folder_name) AS rd,
    row_number() OVER (PARTITION BY location, w ORDER BY ts DESC, folder_name) AS rw,
    row_number() OVER (PARTITION BY location, m ORDER BY ts DESC, folder_name) AS rm,
    dense_rank() OVER (PARTITION BY location ORDER BY d DESC) AS pd,
    dense_rank() OVER (PARTITION BY location ORDER BY w DESC) AS pw,
    dense_rank() OVER (PARTITION BY location ORDER BY m DESC) AS pm
  FROM keyed
),
flagged AS (
  SELECT *, ({level} >= 1 AND rd = 1 AND pd <= 7) AS keep_daily, ({level} >= 2 AND rw = 1 AND pw <= 4) AS keep_weekly,
    ({level} >= 3 AND rm = 1 AND pm <= 12) AS keep_monthly
  FROM ranked
),
rows_in AS (SELECT *, (keep_daily OR keep_weekly OR keep_monthly) AS preserved FROM flagged)"""


_AGE = f"""staged AS (SELECT *, CASE WHEN NOT preserved AND age_days > {DAYS} THEN 'age' END AS reason FROM rows_in)"""
_COUNT = f"""staged AS (
  SELECT *, CASE WHEN NOT preserved AND row_number() OVER (PARTITION BY location, preserved ORDER BY ts DESC, folder_name) > {COUNT}
    THEN 'count' END AS reason FROM rows_in)"""
_SIZE = f"""running AS (
  SELECT *, sum(size_bytes) OVER (PARTITION BY location) AS total,
    coalesce(sum(CASE WHEN NOT preserved THEN size_bytes ELSE 0 END) OVER (PARTITION BY location ORDER BY ts, folder_name
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM rows_in),
staged AS (SELECT *, CASE WHEN NOT preserved AND total - freed > {CAP} THEN 'size' END AS reason FROM running)"""
_ADVANCED = f"""s1 AS (SELECT *, CASE WHEN NOT preserved AND age_days > {DAYS} THEN 'age' END AS r1 FROM rows_in),
s2 AS (
  SELECT *, CASE WHEN r1 IS NOT NULL THEN r1
    WHEN NOT preserved AND row_number() OVER (PARTITION BY location, preserved, r1 IS NULL ORDER BY ts DESC, folder_name) > {COUNT}
    THEN 'count' END AS r2 FROM s1),
s3 AS (
  SELECT *, sum(CASE WHEN r2 IS NULL THEN size_bytes ELSE 0 END) OVER (PARTITION BY location) AS total,
    coalesce(sum(CASE WHEN r2 IS NULL AND NOT preserved THEN size_bytes ELSE 0 END) OVER (PARTITION BY location
      ORDER BY ts, folder_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM s2),
staged AS (
  SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN NOT preserved AND total - freed > {CAP} THEN 'size' END AS reason FROM s3)"""


def _plan_sql(level, stages):
    return f"WITH {_keyed(level)}, {stages} SELECT location, folder_name, preserved, reason FROM staged"


def _preserved_sql(level):
    return (f"WITH {_keyed(level)} SELECT location, folder_name, keep_daily, keep_weekly, keep_monthly "
            "FROM rows_in WHERE preserved")


def _emergency_sql(level, target, eligible, columns):
    return f"""WITH {_keyed(level)}, running AS (
  SELECT *, coalesce(sum(CASE WHEN {eligible} THEN size_bytes ELSE 0 END) OVER (PARTITION BY location ORDER BY ts, folder_name
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM rows_in)
SELECT {columns} FROM running WHERE {eligible} AND freed < {target}"""


def _scenario_sql(name, stages):
    return f"""SELECT '{name}' AS scenario, location, count(*) AS discovered, CAST(0 AS BIGINT) AS preserved,
  count(reason) AS to_delete, CAST(coalesce(sum(CASE WHEN reason IS NOT NULL THEN size_bytes END), 0) AS BIGINT) AS freed_bytes
FROM (WITH {stages} SELECT * FROM staged) GROUP BY location"""


ORACLES = {
    "retention_summary": f"""WITH {_keyed(3)}, {_ADVANCED}
SELECT location, count(*) AS discovered, count(*) FILTER (WHERE preserved) AS preserved,
  count(*) FILTER (WHERE reason = 'age') AS delete_age, count(*) FILTER (WHERE reason = 'count') AS delete_count,
  count(*) FILTER (WHERE reason = 'size') AS delete_size, count(reason) AS to_delete,
  count(*) FILTER (WHERE reason IS NULL) AS kept,
  CAST(coalesce(sum(size_bytes) FILTER (WHERE reason IS NOT NULL), 0) AS BIGINT) AS freed_bytes,
  CAST(coalesce(sum(size_bytes) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS kept_bytes,
  coalesce(sum(size_bytes) FILTER (WHERE reason IS NULL), 0) <= {CAP} AS cap_met
FROM staged GROUP BY location""",
    "preserved_daily": _preserved_sql(1),
    "preserved_weekly": _preserved_sql(2),
    "preserved_monthly": _preserved_sql(3),
    "retention_age": _plan_sql(3, _AGE),
    "retention_count": _plan_sql(3, _COUNT),
    "retention_size": _plan_sql(2, _SIZE),
    "retention_advanced": _plan_sql(3, _ADVANCED),
    "emergency_plan": _emergency_sql(0, CAP, "true", "location, folder_name, age_days, size_bytes"),
    "emergency_plan_preserving": _emergency_sql(1, CAP * 10, "NOT preserved", "location, folder_name, size_bytes"),
    "cleanup_preview": f"WITH {_keyed(0)}\n" + "\nUNION ALL\n".join([
        _scenario_sql("age 400", _AGE.replace(str(DAYS), "400")),
        _scenario_sql("age 1200", _AGE),
        _scenario_sql("count 1500", _COUNT),
        _scenario_sql("size cap", _SIZE),
    ]),
    "simple_retention": f"WITH {CATALOG_SQL} SELECT location, folder_name FROM catalog WHERE age_days > 365",
    "newest_backups": f"""WITH {CATALOG_SQL}, r AS (
  SELECT location, folder_name, row_number() OVER (PARTITION BY location ORDER BY ts DESC, folder_name) AS position FROM catalog)
SELECT * FROM r WHERE position <= 5""",
    "surviving_backups": f"""WITH {_keyed(3)}, {_AGE}
SELECT location, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM staged WHERE reason IS NULL GROUP BY location""",
}
