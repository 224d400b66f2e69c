"""Where a running total reaches a budget, without sorting a whole group in one task.

"Keep the newest 10", "delete the oldest until the rest fits", "free 2 TB" and "the 95th percentile"
all ask for one row per group: the row at which a running total in some order reaches a budget.
One location may hold a third of the catalog, so the group is never sorted as a whole. Totals per
coarse bucket (a day) are aggregated with partial aggregation, which names the one bucket per group
where the budget is reached; that bucket alone is split further while it is large, and only its
rows are finally put in order. Null group keys are a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.session import settle

# A bucket with more rows is split by the next finer bucket before its rows are ordered.
ROWS_IN_ONE_TASK = 1_000_000


@dataclass(frozen=True)
class Key:
    """One sort key: a column name and its direction."""

    name: str
    ascending: bool = True

    def sort(self) -> Column:
        return F.col(self.name).asc() if self.ascending else F.col(self.name).desc()


@dataclass(frozen=True)
class Bucket:
    """A coarser view of the sort order: monotone in it, given the buckets before."""

    expression: Column
    ascending: bool = True


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({key: f"_k_{key}" for key in keys})
    same = [left[key].eqNullSafe(renamed[f"_k_{key}"]) for key in keys]
    return left.join(renamed, same, how).drop(*[f"_k_{key}" for key in keys])


def find_crossing(
    rows: DataFrame,
    keys: list[str],
    order: list[Key],
    buckets: list[Bucket],
    weight: Column,
    budget: Callable[[Column], Column],
    total: Column | None = None,
) -> DataFrame:
    """Per group, the row whose weight lifts the running total from below the budget to it.

    ``weight`` is >= 0; rows of weight 0 are never the answer. ``budget`` receives the group's sum of
    ``total`` (of ``weight`` by default). Result: keys, ``cut_<sort key>``, ``whole``. A group whose
    whole weight stays below the budget has ``whole`` true and null cuts; a group with a budget <= 0
    has no row.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    base = rows.select(
        *keys, *[key.name for key in order],
        *[bucket.expression.alias(name) for bucket, name in zip(buckets, names)],
        weight.alias("_w"), (weight if total is None else total).alias("_t"),
    )
    group = W.partitionBy(*keys)

    def in_order(sort: list[Column]):
        return group.orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)

    def bucket_sort(depth: int) -> Column:
        return F.col(names[depth]).asc() if buckets[depth].ascending else F.col(names[depth]).desc()

    reaches = (F.col("_before") < F.col("_goal")) & (F.col("_before") + F.col("_w") >= F.col("_goal"))

    # Coarsest buckets: one row per group and bucket, however many rows the group has.
    sums = base.groupBy(*keys, names[0]).agg(
        F.sum("_w").alias("_w"), F.sum("_t").alias("_t"), F.count_if(F.col("_w") > 0).alias("_n"))
    first = (
        sums.withColumn("_goal", budget(F.sum("_t").over(group)))
        .withColumn("whole", F.col("_goal") > F.sum("_w").over(group))
        .withColumn("_before", F.coalesce(F.sum("_w").over(in_order([bucket_sort(0)])), F.lit(0)))
        .withColumn("_rank", F.row_number().over(group.orderBy(bucket_sort(0))))
        .where((F.col("whole") & (F.col("_rank") == 1)) | (~F.col("whole") & reaches))
        .select(*keys, names[0], "_goal", "_before", "whole", F.when(~F.col("whole"), F.col("_n")).alias("_n"))
    )
    scope = settle(first, "cutoff")
    whole = scope.where("whole").select(*keys)
    scope = scope.where("NOT whole")
    depth = 1
    while depth < len(buckets) and (scope.agg(F.max("_n")).first()[0] or 0) > ROWS_IN_ONE_TASK:
        finer = (
            join_groups(base.where("_w > 0"), scope.drop("_n", "whole"), keys + names[:depth])
            .groupBy(*keys, *names[: depth + 1])
            .agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"),
                 F.max("_goal").alias("_goal"), F.max("_before").alias("_start"))
            .withColumn("_before", F.col("_start") + F.coalesce(
                F.sum("_w").over(in_order([bucket_sort(depth)])), F.lit(0)))
            .where(reaches)
            .select(*keys, *names[: depth + 1], "_goal", "_before", "_n")
        )
        scope = settle(finer, "cutoff")
        depth += 1

    cuts = [F.col(key.name).alias(f"cut_{key.name}") for key in order]
    rows_there = join_groups(base.where("_w > 0"), scope.select(*keys, *names[:depth], "_goal", F.col("_before").alias("_start")),
                             keys + names[:depth])
    hit = (
        rows_there.withColumn("_before", F.col("_start") + F.coalesce(
            F.sum("_w").over(in_order([key.sort() for key in order])), F.lit(0)))
        .where(reaches)
        .select(*keys, *cuts, F.lit(False).alias("whole"))
    )
    return settle(hit.unionByName(whole.withColumn("whole", F.lit(True)), allowMissingColumns=True), "cutoff")


def mark_reached(
    rows: DataFrame,
    keys: list[str],
    order: list[Key],
    buckets: list[Bucket],
    weight: Column,
    budget: Callable[[Column], Column],
    flag: str,
    total: Column | None = None,
) -> DataFrame:
    """Add ``flag``: the weight of the rows before this one has not yet reached the budget.

    The crossing rows are found by bucket totals and joined back: at most one row per group, whose
    true size is known because it was written, so it is broadcast while small and joined by shuffle,
    with skewed groups split, beyond that.
    """
    cut = find_crossing(rows, keys, order, buckets, weight, budget, total)
    not_after = F.lit(True)
    for key in reversed(order):
        here, there = F.col(key.name), F.col(f"cut_{key.name}")
        before = here < there if key.ascending else here > there
        not_after = before | ((here == there) & not_after)
    inside = F.coalesce(F.col("whole"), F.lit(False)) | F.coalesce(not_after, F.lit(False))
    return join_groups(rows, cut, keys, "left").withColumn(flag, inside).drop("whole", *[f"cut_{key.name}" for key in order])
