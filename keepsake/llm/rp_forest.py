"""Embedding near-dedup by a random-projection tree forest.

Each tree splits the vectors again and again along random directions; vectors close to a split go to
both sides. Vectors are compared only within leaves, by exact cosine. The number of trees follows from
the depth: a pair at the threshold is parted by one split with a known chance, so enough trees are grown
that it meets in some leaf with probability ``recall``. Closer pairs meet more often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import components
from keepsake.session import settle

THRESHOLD = 0.9
RECALL = 0.998
#: Vectors a leaf should hold, and the most one task compares with one block of others.
LEAF = 1024
BLOCK = 2048
#: Numbers in the sample that splits are fitted on, levels fitted on one sample, and half the width of the
#: overlap as a share of the spread that pairs at the threshold show along a random direction.
SAMPLE_NUMBERS = 1 << 20
LEVELS = 8
SPILL = 0.25
#: Chance that a split parts a pair at cosine 0.9 beyond this overlap, as a share of the angle over pi.
_BEYOND_SPILL = 0.5
_SEED = 42
_NO_SPLIT = float("nan")


def _trees(depth: int, threshold: float, recall: float) -> int:
    parted = math.acos(threshold) / math.pi * _BEYOND_SPILL
    met = (1 - parted) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1 - met, 1e-12)))) if depth else 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    rows = vectors.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _directions(dim: int, levels: int, *seed: int) -> np.ndarray:
    rows = np.random.default_rng([_SEED, dim, *seed]).standard_normal((dim, levels))
    return rows / np.linalg.norm(rows, axis=0)


def _fit(sample: np.ndarray, directions: np.ndarray, width: float, least: float) -> np.ndarray:
    """Thresholds of a tree in heap order. Each split takes the emptiest place near the middle of its
    sample; a node that no place parts (most rows would go both ways) and a small node stay whole."""
    levels = directions.shape[1]
    cuts = np.full(2**levels - 1, _NO_SPLIT)
    at = {0: np.arange(len(sample))}
    along = sample @ directions
    for level in range(levels):
        below = {}
        for node, rows in at.items():
            values = np.sort(along[rows, level])
            if len(values) < max(least, 8):
                continue
            places = np.quantile(values, np.linspace(0.35, 0.65, 13))
            both = np.searchsorted(values, places + width) - np.searchsorted(values, places - width)
            best = int(np.argmin(both))
            if both[best] > len(values) / 2:
                continue
            cuts[node] = places[best]
            value = along[rows, level]
            below[2 * node + 1], below[2 * node + 2] = rows[value < places[best] + width], rows[value >= places[best] - width]
        at = below
    return cuts


def _route(units: np.ndarray, directions: np.ndarray, cuts: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs; a leaf is the heap number of the node where a row stays."""
    along = units @ directions
    rows, nodes = np.arange(len(units)), np.zeros(len(units), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(directions.shape[1]):
        cut = cuts[nodes]
        stay = np.isnan(cut)
        ends.append((rows[stay], nodes[stay]))
        rows, nodes, cut = rows[~stay], nodes[~stay], cut[~stay]
        value = along[rows, level]
        left, right = value < cut + width, value >= cut - width
        rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
    ends.append((rows, nodes))
    return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _first_round(dim: int, levels: int, forest: list[np.ndarray], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, units = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1), dim))
            for tree, cuts in enumerate(forest):
                rows, leaf = _route(units, _directions(dim, levels, 0, tree), cuts, width)
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(leaf + tree * 2 ** (levels + 1))], names=["node", "leaf"])

    return run


def _later_round(dim: int, levels: int, number: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, leaves, stuck = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            cuts = batch.column(3)
            units = _unit(_matrix(batch.column(2), dim)) if len(batch) else np.zeros((0, dim))
            for leaf in np.unique(leaves):
                here = np.flatnonzero(leaves == leaf)
                tree = np.array(cuts[int(here[0])].as_py(), np.float64)
                rows, end = _route(units[here], _directions(dim, levels, number, int(leaf) & 0xFFFFFFFF), tree, width)
                name = (np.uint64(int(leaf) & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15) + end.astype(np.uint64) + np.uint64(1)).view(np.int64)
                stuck = np.full(len(rows), bool(np.isnan(tree[0])))
                yield pa.RecordBatch.from_arrays([pa.array(node[here[rows]]), pa.array(name), pa.array(stuck)], names=["node", "leaf", "stuck"])

    return run


def _later_fit(dim: int, levels: int, number: int, width: float, leaf: int):
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        units = _unit(np.array(rows["embedding"].tolist()))
        cuts = _fit(units, _directions(dim, levels, number, int(key[0]) & 0xFFFFFFFF), width, leaf * len(units) / rows["count"].iloc[0])
        return pd.DataFrame({"leaf": [key[0]], "cuts": [cuts.tolist()]})

    return fit


def _leaves(vectors: DataFrame, dim: int, count: int, threshold: float, recall: float, leaf: int) -> DataFrame:
    """(node, leaf): every leaf of every tree that a vector lies in."""
    depth = max(0, math.ceil(math.log2(max(count, 1) / leaf)))
    levels = min(depth, LEVELS)
    width = SPILL * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    wanted = max(64, SAMPLE_NUMBERS // dim)
    chosen = vectors.where(F.pmod(F.xxhash64("node", F.lit(_SEED)), F.lit(count)) < wanted) if count > wanted else vectors
    sample = np.array([r[0] for r in chosen.select("embedding").limit(2 * wanted).collect()], np.float64).reshape(-1, dim)
    units = _unit(sample)
    least = leaf * len(units) / max(count, 1)
    forest = [_fit(units, _directions(dim, levels, 0, t), width, least) for t in range(_trees(depth, threshold, recall))]
    found = settle(vectors.select("node", "embedding").mapInArrow(_first_round(dim, levels, forest, width), "node long, leaf long")
                   .withColumn("stuck", F.lit(False)), "leaves")
    number = 0
    while levels:
        number += 1
        large = settle(found.where(~F.col("stuck")).groupBy("leaf").count().where(F.col("count") > 4 * leaf), "large")
        if large.isEmpty():
            break
        opened = found.join(large, "leaf").join(vectors, "node").select("node", "leaf", "embedding", "count")
        some = opened.where(F.pmod(F.xxhash64("node", "leaf"), "count") < wanted)

        cuts = settle(some.groupBy("leaf").applyInPandas(_later_fit(dim, LEVELS, number, width, leaf), "leaf long, cuts array<double>"), "cuts")
        moved = opened.join(cuts, "leaf").select("node", "leaf", "embedding", "cuts")
        moved = moved.mapInArrow(_later_round(dim, LEVELS, number, width), "node long, leaf long, stuck boolean")
        found = settle(found.join(large, "leaf", "left_anti").select("node", "leaf", "stuck").union(moved), "leaves")
    return found.select("node", "leaf").distinct()


def _compare(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        units = _unit(np.array(rows["embedding"].tolist()))
        node, copies, side = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        # A pair that meets in several leaves counts in the first of them.
        before = [[x for x in own if x < key[0]] for own in rows["leaves"]]
        codes = {x: i for i, x in enumerate(sorted({x for own in before for x in own}))}
        met = np.zeros((len(rows), max(len(codes), 1)), np.float32)
        for i, own in enumerate(before):
            met[i, [codes[x] for x in own]] = 1
        links = np.zeros(len(rows), np.int64)
        left, right = [], []
        for start in range(0, len(rows), 512):
            some = slice(start, start + 512)
            near = (units[some] @ units.T >= threshold) & (met[some] @ met.T == 0)
            near &= np.arange(len(rows))[None, :] > np.arange(start, start + near.shape[0])[:, None]
            near &= (side[some, None] != side[None, :]) | (side[some, None] == 0)
            a, b = np.nonzero(near)
            a += start
            links += np.bincount(a, copies[b], len(rows)).astype(np.int64) + np.bincount(b, copies[a], len(rows)).astype(np.int64)
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        label = np.arange(len(rows))
        while True:
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            least = least[least]
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": node[some], "root": node[label[some]], "links": links[some]})

    return run


def _links(vectors: DataFrame, dim: int, count: int, threshold: float, recall: float, leaf: int, block: int) -> DataFrame:
    """(node, root, links): links found in one leaf, and a node of the leaf that they lead to."""
    found = settle(_leaves(vectors, dim, count, threshold, recall, leaf), "found")
    own = found.groupBy("node").agg(F.collect_set("leaf").alias("leaves"))
    rows = vectors.join(own, "node").withColumn("leaf", F.explode("leaves"))
    sizes = settle(found.groupBy("leaf").count(), "sizes")
    rows = rows.join(sizes.where(F.col("count") > 1), "leaf")
    parts = F.ceil(F.col("count") / block)
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select("leaf", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "node", "copies",
                       "leaves", "embedding")
    return rows.groupBy("leaf", "low", "high").applyInPandas(_compare(threshold), "node long, root long, links long")


def _usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL,
                    leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors with cosine at or above ``threshold``, component_id is the smallest
    vec_id that links reach, kept says whether that is the vector itself. Equal vectors are one node with
    a number of copies, so copies cost nothing; a leaf that stays too large (no direction parts it) is
    compared in pairs of blocks, and only spanning links leave a task. Vectors that are null, zero or hold
    null or non-finite numbers link with nothing; vectors of different lengths never link. Repeated rows
    are vectors of their own; rows with a null id count as links, but are no component_id and are kept
    only where no member has an id. Columns not named are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.withColumn("usable", _usable(F.col("embedding")))
    node, again = F.when(F.col("usable"), F.xxhash64("embedding")), F.when(F.col("usable"), F.xxhash64("embedding", F.lit(1)))
    rows = rows.select("vec_id", node.alias("node"), again.alias("again"), F.when(F.col("usable"), F.col("embedding")).alias("embedding"))
    members = settle(rows.select("vec_id", "node", "again"), "members")
    classes = rows.where("node IS NOT NULL").groupBy("node", "again").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = settle(classes.withColumn("dim", F.size("embedding")), "classes")
    dims = classes.groupBy("dim").count().collect()
    found = [_links(classes.where(F.col("dim") == d["dim"]).select("node", "copies", "embedding"), d["dim"], d["count"], threshold, recall, leaf, block)
             for d in dims]
    if not found:
        alone = F.col("vec_id")
        return members.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    links = settle(reduce(DataFrame.union, found), "links")
    reached = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    classes = classes.select("node", "again", "copies", "least").join(counted, F.col("node") == F.col("n"), "left").drop("n")
    reached = reached.withColumnRenamed("node", "n")
    classes = settle(classes.join(reached, F.col("node") == F.col("n"), "left").select(
        "node", "again", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("label")), "labels")
    best = classes.groupBy("label").agg(F.min("least").alias("best"))
    known = classes.join(best, "label").select("node", "again", "n_links", "best")
    out = members.join(known, ["node", "again"], "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("best"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
