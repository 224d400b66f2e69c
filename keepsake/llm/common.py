"""Helpers shared by the operators: tables, word splitting, connected components, weighted cut points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keepsake.session import settle

#: Java pattern of what separates words: blank, tab to carriage return.
SPACES = "[ \\t-\\r]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows whose labels no model may see; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def key_of(doc_id: Column, text: Column) -> Column:
    """A key that is never null: the id, or for a null id a negative number made from the text."""
    made = F.lit(-2) - F.shiftrightunsigned(F.xxhash64(text), 2)
    return F.coalesce(doc_id.cast("bigint"), made)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each linked node reaches; ``links`` holds (a, b) as long.

    Alternating large-star and small-star rounds, each a written table, until nothing changes.
    Hubs are reduced by partial aggregation; a row is emitted per link, never per pair of neighbours.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, seen = settle(pairs, "links"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = pairs.select(F.col("u").alias("n"), F.col("v").alias("x")).union(pairs.select("v", "u"))
        least = both.groupBy("n").agg(F.min("x").alias("x")).select("n", F.least("n", "x").alias("m"))
        large = pairs.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v")).distinct()
        lowest = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(lowest, F.col("u") == F.col("n")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = settle(small.select("e.u", "e.v").where("u <> v").distinct(), "star")
    ends = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.union(roots)


KEY_BITS, STEP_BITS = 48, 12


def cut_points(rows: DataFrame, targets: DataFrame, rounds: int = KEY_BITS // STEP_BITS) -> DataFrame:
    """Where the running weight of each group comes nearest to its target: (part, cut).

    ``rows`` has part, key (0 to 2^48 - 1) and weight; ``targets`` has part and target. Rows with
    ``key < cut`` hold the target's weight as nearly as whole keys allow. Each round sums weights per
    bin of 12 more bits with partial aggregates and goes on in the one bin that holds the target, so no
    group is ever sorted in one place.
    """
    state = targets.select("part", F.col("target").cast("double").alias("target"), F.lit(0).cast("bigint").alias("prefix"),
                           F.lit(0.0).alias("before"), F.lit(0.0).alias("inside"))
    for step in range(1, rounds + 1):
        rest = KEY_BITS - step * STEP_BITS
        binned = rows.join(state.select("part", "prefix"), "part").where(F.shiftright("key", rest + STEP_BITS) == F.col("prefix"))
        sums = binned.groupBy("part", F.shiftright("key", rest).alias("bin")).agg(F.sum("weight").cast("double").alias("w"))
        upto = F.sum("w").over(W.partitionBy("part").orderBy("bin"))
        met = sums.join(state.select("part", "target", "before"), "part").withColumn("upto", F.col("before") + upto)
        met = met.withColumn("late", F.col("upto") < F.col("target"))
        first = F.struct("late", F.when(F.col("late"), -F.col("bin")).otherwise(F.col("bin")), "bin", "upto", "w")
        found = met.groupBy("part", "target").agg(F.min(first).alias("f"))
        state = settle(found.select("part", "target", F.col("f.bin").alias("prefix"),
                                    (F.col("f.upto") - F.col("f.w")).alias("before"), F.col("f.w").alias("inside")), "cuts")
    over = F.abs(F.col("before") + F.col("inside") - F.col("target")) <= F.abs(F.col("before") - F.col("target"))
    rest = KEY_BITS - rounds * STEP_BITS
    return state.select("part", F.shiftleft(F.col("prefix") + over.cast("bigint"), rest).alias("cut"))


def training_rows(labels: DataFrame, label: str, most: int, seed: int = 42) -> DataFrame:
    """(doc_id, y) of rows labelled 0 or 1 outside the held-out fifth; of each label ``most`` rows, give or
    take chance, chosen by a hash of the id. The result is bounded by ``most`` and may be broadcast."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = settle(known.where(~held_out(F.col("doc_id"))).distinct(), "known")
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(max(total.get(1, 0), 1))).otherwise(F.lit(max(total.get(0, 0), 1)))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), share) < most)
    # How many labelled rows one chosen row stands for.
    return settle(known.withColumn("weight", F.greatest(share / float(most), F.lit(1.0))), "training")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, share = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * w
        w -= np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge * np.eye(len(w)), slope)
        if np.abs(slope).max() < 1e-9:
            break
    return w
