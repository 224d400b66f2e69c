"""Sharding by k-d tree partitioning: splits at distributed weighted medians of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keepsake.llm.common import cut_points
from keepsake.session import settle

#: Rows of one numbering task, about.
SLOT_ROWS = 100_000
_HALF = 1 << 24


def _text_ranks(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the texts of a column replaced by their places among its different texts, from 1; null is 0.

    The different texts are sorted in ranges over all tasks and numbered task by task.
    """
    place, task = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("__at", 33)
    found = rows.select(F.col(name).alias("__value")).where("__value IS NOT NULL").distinct().orderBy("__value")
    found = settle(found.withColumn("__at", F.monotonically_increasing_id()).select("__value", task.alias("__task"), place.alias("__place")), "values")
    before = F.sum("count").over(W.orderBy("__task")) - F.col("count")  # a row a task
    starts = found.groupBy("__task").count().select("__task", before.alias("__before"))
    ranks = settle(found.join(starts, "__task").select("__value", (F.col("__before") + F.col("__place") + 1).cast("double").alias("__rank")), "ranks")
    ranked = rows.join(ranks, F.col(name) == F.col("__value"), "left")
    return ranked.withColumn(name, F.coalesce("__rank", F.lit(0.0))).drop("__value", "__rank")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id",
          text: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts are one point, so they share a shard. Points have as coordinates their
    size, smallest id and smallest ``metadata``, each scaled to 0..1; texts count by their place in the order
    of all different texts of their column. A node for k shards is cut along its
    widest coordinate where its bytes stand k // 2 to the rest; a leaf is one shard, and the number of
    shards is given, or the total over ``target_bytes``. Bytes per shard (law ``bytes``) are equal up to
    the size of one text with its copies. Ties in a coordinate are cut by a hash of the text.

    Size is the text's UTF-8 bytes plus 8. Null and empty texts are equal and have checksum 0; repeated
    rows take a slot each; null ids and null metadata sort first; columns not named are not read.
    ``slot`` counts from 0 without gaps in each shard. ``grown_shard`` belongs to the law ``key``: null.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    dims = {"__size": F.log2(F.octet_length(body) + 8.0), "__id": F.col(doc_id).cast("double")}
    kinds = dict(docs.dtypes)
    for name in metadata:
        dims[f"__{name}"] = F.col(name) if kinds[name] == "string" else F.col(name).cast("double")
    rows = settle(docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h1"), F.xxhash64(body, F.lit(1)).alias("h2"),
        *[e.alias(n) for n, e in dims.items()]), "rows")
    measured = rows
    for name in metadata:
        if kinds[name] == "string":
            measured = _text_ranks(measured, f"__{name}")
    measured = measured.fillna(0.0, list(dims))
    points = settle(measured.groupBy("h1", "h2").agg(F.sum("size").alias("weight"), *[F.min(n).alias(n) for n in dims]), "points")
    limits = points.agg(F.sum("weight").alias("all"), *[F.min(n).alias(f"lo{n}") for n in dims], *[F.max(n).alias(f"hi{n}") for n in dims]).first()
    total = limits["all"] or 0
    count = shards or max(1, -(-total // target_bytes))
    for n in dims:
        lo, hi = limits[f"lo{n}"] or 0.0, limits[f"hi{n}"] or 0.0
        points = points.withColumn(n, (F.col(n) - F.lit(lo)) / F.lit((hi - lo) or 1.0))
    tie = F.shiftrightunsigned("h1", 40)
    # Written, so that the first node joins by its number like all later ones.
    leaves = settle(points.select("h1", "h2", "weight", *dims, tie.alias("tie"), F.lit(0).cast("bigint").alias("part"), F.lit(count).cast("bigint").alias("k")), "leaves")
    for _ in range((count - 1).bit_length()):
        spans = [F.max(n) - F.min(n) for n in dims]
        widest = F.greatest(*spans)
        axis = F.coalesce(*[F.when(s == widest, F.lit(i)) for i, s in enumerate(spans)], F.lit(0))
        nodes = settle(leaves.where("k > 1").groupBy("part", "k").agg(axis.alias("axis"), F.sum("weight").alias("w"))
                       .withColumn("target", F.col("w") * F.floor(F.col("k") / 2) / F.col("k")), "nodes")
        along = F.element_at(F.array(*dims), F.col("axis") + 1)
        key = F.shiftleft(F.floor(along * (_HALF - 1)).cast("bigint"), 24) + F.col("tie")
        keyed = leaves.join(nodes.select("part", "axis"), "part", "left").withColumn("key", key)
        cuts = cut_points(keyed.where("axis IS NOT NULL").select("part", "key", "weight"), nodes, rounds=3)
        moved = keyed.join(cuts, "part", "left")
        right = F.coalesce(F.col("key") >= F.col("cut"), F.lit(False))
        low = F.floor(F.col("k") / 2)
        leaves = settle(moved.select("h1", "h2", "weight", *dims, "tie", F.when(right, F.col("part") + low).otherwise(F.col("part")).alias("part"),
                                     F.when(F.col("cut").isNull(), F.col("k")).when(right, F.col("k") - low).otherwise(low).alias("k")), "leaves")
    placed = rows.select("doc_id", "size", "text_crc32", "h1", "h2").join(leaves.select("h1", "h2", "part"), ["h1", "h2"])
    return _slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("part").cast("int").alias("shard"), "slot",
                                 F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers from 0 in each shard: offsets of hashed pieces, then row numbers within a piece."""
    placed = settle(placed, "placed")
    pieces = max(1, placed.count() // SLOT_ROWS)
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(pieces)))
    sizes = placed.groupBy("part", "piece").count()
    before = F.sum("count").over(W.partitionBy("part").orderBy("piece")) - F.col("count")
    starts = sizes.select("part", "piece", before.alias("start"))
    number = F.row_number().over(W.partitionBy("part", "piece").orderBy("h1", "h2", "doc_id"))
    return placed.join(starts, ["part", "piece"]).withColumn("slot", (F.col("start") + number - 1).cast("bigint"))
