"""Per-row history (sums and previous value over all earlier rows) without one task per group.

A group such as one environment may hold a third of all runs. Bucket summaries (per day, per
second) carry the history across buckets, and only the rows of one finest bucket are ordered
together. Null group keys are a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.operators.cutoff import join_groups


def _bucketed(rows: DataFrame, buckets: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_b{i}" for i in range(len(buckets))]
    return rows.withColumns(dict(zip(names, buckets))), names


def prior_sums(rows: DataFrame, keys: list[str], order: list[str], buckets: list[Column],
               measures: dict[str, Column]) -> DataFrame:
    """Add ``prior_<name>``: the sum of each measure over all earlier rows of the group, 0 for none.

    ``buckets`` go from coarse to fine, and each follows ``order`` within the one before.
    """
    base, names = _bucketed(rows, buckets)
    base = base.withColumns({f"_m_{name}": measure for name, measure in measures.items()})
    finest = base.groupBy(*keys, *names).agg(*[F.sum(f"_m_{m}").alias(f"_m_{m}") for m in measures])

    offsets = None
    for depth in range(len(names)):
        here = keys + names[: depth + 1]
        level = finest if depth == len(names) - 1 else finest.groupBy(*here).agg(
            *[F.sum(f"_m_{m}").alias(f"_m_{m}") for m in measures])
        earlier = W.partitionBy(*keys, *names[:depth]).orderBy(names[depth]).rowsBetween(W.unboundedPreceding, -1)
        level = level.select(*here, *[F.coalesce(F.sum(f"_m_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures])
        if offsets is None:
            offsets = level
        else:
            above = offsets.withColumnsRenamed({f"_o_{m}": f"_p_{m}" for m in measures})
            offsets = join_groups(level, above, keys + names[:depth]).select(
                *here, *[(F.col(f"_o_{m}") + F.col(f"_p_{m}")).alias(f"_o_{m}") for m in measures])

    earlier = W.partitionBy(*keys, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = join_groups(base, offsets, keys + names)
    joined = joined.withColumns({
        f"prior_{m}": F.col(f"_o_{m}") + F.coalesce(F.sum(f"_m_{m}").over(earlier), F.lit(0)) for m in measures})
    return joined.select(*rows.columns, *[f"prior_{m}" for m in measures])


def prior_value(rows: DataFrame, keys: list[str], order: list[str], buckets: list[Column],
                value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the row just before in the group, null for the first."""
    base, names = _bucketed(rows, buckets)
    # A struct tells "no earlier row" (null) from "earlier row with a null value".
    finest = base.groupBy(*keys, *names).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))

    offsets = None
    for depth in range(len(names)):
        here = keys + names[: depth + 1]
        level = finest if depth == len(names) - 1 else finest.groupBy(*here).agg(
            F.max_by("_last", F.struct(*names[depth + 1:])).alias("_last"))
        level = level.select(*here, F.lag("_last").over(W.partitionBy(*keys, *names[:depth]).orderBy(names[depth])).alias("_before"))
        if offsets is None:
            offsets = level
        else:
            above = offsets.withColumnRenamed("_before", "_above")
            offsets = join_groups(level, above, keys + names[:depth]).select(
                *here, F.coalesce("_before", "_above").alias("_before"))

    within = W.partitionBy(*keys, *names).orderBy(*order)
    joined = join_groups(base, offsets, keys + names)
    previous = F.coalesce(F.lag(F.struct(value)).over(within), F.col("_before"))
    return joined.withColumn(name, previous[value]).select(*rows.columns, name)
