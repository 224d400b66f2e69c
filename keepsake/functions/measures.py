"""Sizes, status labels, threshold comparison and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bands as (label, lower, upper).
HEALTH_BANDS = [("excellent", 95, 100), ("good", 85, 95), ("warning", 75, 85), ("critical", 0, 75)]
STORAGE_BANDS = [("green", 0, 70), ("yellow", 70, 85), ("red", 85, 100)]
RISK_BANDS = [("green", 0, 3), ("yellow", 3, 6), ("orange", 6, 8), ("red", 8, 10)]
GOVERNANCE_FLOORS = [("excellent", 90), ("good", 80), ("fair", 70), ("poor", 60)]


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1024.0**2)


def size_gb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1024.0**3)


def array_length(array: Column) -> Column:
    return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))


def or_unknown(value: Column) -> Column:
    return F.coalesce(value, F.lit("Unknown"))


def preservation_status(preserved: Column) -> Column:
    return F.when(preserved, F.lit("Preserved")).otherwise(F.lit("Available for cleanup"))


def band(value: Column, bands: list[tuple[str, float, float]]) -> Column:
    """Band label; lower bound inclusive, upper exclusive, the top band closed. Null outside all."""
    top = max(upper for _, _, upper in bands)
    label = F.lit(None).cast("string")
    for name, lower, upper in bands:
        within = (value >= lower) & ((value <= upper) if upper == top else (value < upper))
        label = F.when(within, F.lit(name)).otherwise(label)
    return label


def floor_band(value: Column, floors: list[tuple[str, float]], below: str) -> Column:
    """First label, from the highest floor down, whose floor the value reaches."""
    label = F.when(value.isNotNull(), F.lit(below))
    for name, floor in sorted(floors, key=lambda item: item[1]):
        label = F.when(value >= floor, F.lit(name)).otherwise(label)
    return label


def severity(value: Column, warning: Column, critical: Column) -> Column:
    """ok / warning / critical; a warning above the critical threshold means that low is bad."""
    rising = warning <= critical
    is_critical = F.when(rising, value >= critical).otherwise(value <= critical)
    is_warning = F.when(rising, value >= warning).otherwise(value <= warning)
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(is_critical, F.lit("critical")).when(is_warning, F.lit("warning")).otherwise(F.lit("ok")))


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """Comparison whose operator is itself a column."""
    return (F.when(op == ">=", value >= threshold).when(op == ">", value > threshold)
            .when(op == "<", value < threshold).when(op == "<=", value <= threshold)
            .when(op == "==", value == threshold).when(op == "!=", value != threshold))


def run_status(failed: Column, succeeded: Column | None = None) -> Column:
    """success without failures; failed when nothing succeeded; partial_success between."""
    status = F.when(failed == 0, F.lit("success"))
    if succeeded is not None:
        status = status.when(succeeded == 0, F.lit("failed"))
    return status.otherwise(F.lit("partial_success"))
