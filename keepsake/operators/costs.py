"""Governance, compliance and cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import measures, periods

# Weights of the governance score.
GOVERNANCE_WEIGHTS = {
    "data_classification_coverage": 0.3,
    "lineage_completeness": 0.25,
    "policy_compliance_rate": 0.25,
    "access_control_effectiveness": 0.2,
}
# Frameworks of the compliance score and the score they need.
FRAMEWORKS = ["SOX", "GDPR", "HIPAA", "PCI-DSS"]
REQUIRED_COMPLIANCE = 95


def governance_score(components: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted average of the components present, with its band. Rows: keys, component, value."""
    weight = F.lit(None).cast("double")
    for name, value in GOVERNANCE_WEIGHTS.items():
        weight = F.when(F.col("component") == name, F.lit(value)).otherwise(weight)
    rows = components.withColumn("_w", weight).where(F.col("_w").isNotNull())
    score = F.round(F.sum(F.col("value") * F.col("_w")) / F.sum("_w"), 8)
    return rows.groupBy(*keys).agg(score.alias("governance_score")).withColumn(
        "band", measures.floor_band(F.col("governance_score"), measures.GOVERNANCE_FLOORS, "below"))


def compliance_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest framework score and whether it is enough. Rows: keys, framework, score."""
    return scores.groupBy(*keys).agg(F.min("score").alias("compliance_score")).withColumn(
        "compliant", F.col("compliance_score") >= REQUIRED_COMPLIANCE)


def cost_efficiency(costs: DataFrame, keys: list[str], protected_bytes: Column, cost: Column) -> DataFrame:
    """Terabytes protected per unit of cost; null without cost."""
    ratio = F.sum(protected_bytes) / F.lit(1024.0**4) / F.nullif(F.sum(cost), F.lit(0).cast("bigint"))
    return costs.groupBy(*keys).agg(F.round(ratio, 6).alias("tb_per_cost")).withColumn(
        "on_target", F.coalesce(F.col("tb_per_cost") > 10, F.lit(False)))


def optimisation_potential(costs: DataFrame, keys: list[str], savings: Column, current: Column) -> DataFrame:
    """Savings as a percentage of current cost: high above 20, medium from 10, else low."""
    percent = F.round(F.sum(savings) * 100.0 / F.nullif(F.sum(current), F.lit(0).cast("bigint")), 6)
    p = F.col("potential_percent")
    return costs.groupBy(*keys).agg(percent.alias("potential_percent")).withColumn(
        "potential", F.when(p > 20, F.lit("high")).when(p >= 10, F.lit("medium")).when(p.isNotNull(), F.lit("low")))


def top_savings(costs: DataFrame, resource: str, current: Column, savings: Column, n: int = 10) -> DataFrame:
    """The n resources with the largest savings."""
    sums = costs.groupBy(F.col(resource).alias("resource")).agg(
        F.sum(current).alias("current_cost"), F.sum(savings).alias("potential_savings"))
    sums = sums.withColumn("optimized_cost", F.col("current_cost") - F.col("potential_savings"))
    return sums.orderBy(F.col("potential_savings").desc(), F.col("resource")).limit(n)


def budget_alerts(spend: DataFrame, budgets: DataFrame, keys: list[str], unit: str, threshold: int) -> DataFrame:
    """Spend per calendar unit against the budget of the group.

    ``spend``: keys, ts, cost; ``budgets``: keys, budget. Joined after the aggregation.
    """
    per_unit = spend.groupBy(*keys, F.trunc(F.col("ts").cast("date"), unit).cast("string").alias("period")).agg(
        F.sum("cost").alias("spend"))
    used = F.col("spend") * 100.0 / F.nullif(F.col("budget"), F.lit(0).cast("bigint"))
    return per_unit.join(budgets, keys, "left").select(
        *keys, "period", "spend", "budget", F.round(used, 6).alias("used_percent"),
        F.coalesce(used >= threshold, F.lit(False)).alias("alert"))


def monthly_trend(costs: DataFrame, types: list[str], since: Column) -> DataFrame:
    """One row per month, one column per cost type. Rows: ts, cost_type, cost."""
    months = costs.where(F.col("ts") >= since).groupBy(periods.month_key(F.col("ts")).alias("month"))
    return months.agg(*[
        F.coalesce(F.sum(F.when(F.col("cost_type") == name, F.col("cost"))), F.lit(0).cast("bigint")).alias(f"{name}_costs")
        for name in types])


def overall_status(runs: DataFrame) -> DataFrame:
    """Success only if the backup succeeded and the cleanup was off or did not fail."""
    good = (F.col("backup_status") == "Success") & (
        ~F.col("cleanup_enabled") | F.coalesce(F.col("cleanup_status") != "Failed", F.lit(True)))
    return runs.withColumn("overall_status", F.when(good, F.lit("Success")).otherwise(F.lit("Failed")))


def consolidated(results: DataFrame, keys: list[str]) -> DataFrame:
    """Lakehouses per group by their latest result. Rows: keys, lakehouse, ts, execution_id, status.

    One row per lakehouse is made first, so the report never gathers results in a list.
    """
    each = results.groupBy(*keys, "lakehouse").agg(
        F.max_by("status", F.struct("ts", "execution_id")).alias("status"), F.count(F.lit(1)).alias("runs"))
    return each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lakehouses"), F.sum("runs").alias("runs"),
        F.count_if(F.col("status") == "Success").alias("succeeded"),
        F.count_if(F.col("status") == "Failed").alias("failed"))
