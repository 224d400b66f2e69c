"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keepsake.llm.common import KEY_BITS, cut_points, words
from keepsake.session import settle

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
_UNIT = 1 << 52


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def _in_turn(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources with the weights in turn, in the order of their names, null last.

    Names are cut into ranges, numbered within each, and the ranges' sizes added up: no task holds all sources.
    """
    name = F.col("source").asc_nulls_last()
    ranged = settle(sizes.repartitionByRange(name).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").count()
    starts = counts.select("range", (F.sum("count").over(W.orderBy("range")) - F.col("count")).alias("start"))
    number = F.col("start") + F.row_number().over(W.partitionBy("range").orderBy(name)) - 1
    taken = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    return ranged.join(starts, "range").select("source", "source_size", taken.alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of their names, null last, take the weights in turn. A target above ``most``
    times its source stops there; the excess is shared again by weight until none is above. Each sharing is
    one aggregate: words per weight only rise, so a source that has stopped stays stopped, and the rounds end.
    """
    weighted = settle(_in_turn(sizes, weights), "weighted")
    budget = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    stopped, before = F.lit(False), 0
    while True:
        held, open_ = weighted.agg(F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_:
            stopped, level = F.lit(True), 0.0
            break
        level = (budget - (held or 0) * most) / open_
        stopped = F.col("weight") * F.lit(level) > F.col("source_size") * most
        count = weighted.where(stopped).count()
        if count <= before:
            break
        before = count
    target = F.when(stopped, F.col("source_size") * float(most)).otherwise(F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", target.cast("double").alias("target"))


def _prepared(docs: DataFrame, doc_id: str, text: str, source: str, rank_weight: str | None) -> DataFrame:
    """``docs`` with what mixing needs, under names of its own."""
    own = F.col(rank_weight).cast("double") if rank_weight else F.length(F.bin(word_count(F.col(text)))).cast("double")
    like = F.coalesce(F.greatest(own, F.lit(0.0)), F.lit(0.0))
    return docs.withColumns({"__llm_id": F.col(doc_id).cast("bigint"), "__llm_source": F.col(source), "__llm_size": word_count(F.col(text)),
                             "__llm_h": F.xxhash64(F.col(text)), "__llm_like": like})


_PREPARED = ["__llm_id", "__llm_source", "__llm_size", "__llm_h", "__llm_like"]


def _key(seed: int) -> Column:
    """Pareto's rank, odds of a random number over odds of inclusion, as a whole number that grows with it.

    The random number comes from the id and the text, the same in every run. The chance of inclusion is the
    fraction of its words that a source still misses, moved towards the liked documents, inside (0, 1).
    """
    chance = F.when(F.col("liked") > 0, F.col("rest") * F.col("__llm_like") * F.col("source_size") / F.col("liked")).otherwise(F.col("rest"))
    chance = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    u = (F.shiftrightunsigned(F.xxhash64("__llm_id", "__llm_h", F.lit(seed)), 12).cast("double") + 0.5) / float(_UNIT)
    odds = (u / (1 - u)) / (chance / (1 - chance))
    return F.least(F.floor(odds / (1 + odds) * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("bigint")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """One row per source: s, source_size, liked, target, whole copies, rest and cut (rank below which one more is taken)."""
    by_source = settle(rows.groupBy(F.col("__llm_source").alias("source")).agg(
        F.sum("__llm_size").alias("source_size"), F.sum((F.col("__llm_size") * F.col("__llm_like")).cast("decimal(38,6)")).cast("double").alias("liked")), "sources")
    goals = targets(by_source.select("source", "source_size"), weights, share, most)
    goals = goals.join(by_source.select(F.col("source").alias("s"), "liked"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(wanted + 1e-12), F.lit(most))
    goals = goals.withColumn("whole", whole).withColumn("rest", F.greatest(wanted - F.col("whole"), F.lit(0.0)))
    goals = settle(goals.withColumn("part", F.xxhash64("s", F.col("s").isNull())), "plan")
    open_ = goals.where("rest > 0")
    keyed = rows.join(open_, F.col("__llm_source").eqNullSafe(F.col("s")))
    keyed = keyed.select("part", _key(seed).alias("key"), F.col("__llm_size").alias("weight"))
    cuts = cut_points(keyed, open_.select("part", (F.col("target") - F.col("whole") * F.col("source_size")).alias("target")))
    return settle(goals.join(cuts, "part", "left").drop("part"), "planned")


def _with_copies(rows: DataFrame, planned: DataFrame, seed: int, most: int) -> DataFrame:
    more = F.coalesce((F.col("rest") > 0) & (F.col("__llm_key") < F.col("cut")), F.lit(False)).cast("bigint")
    joined = rows.join(planned, F.col("__llm_source").eqNullSafe(F.col("s"))).withColumn("__llm_key", _key(seed))
    return joined.withColumn("__llm_copies", F.least(F.col("whole") + more, F.lit(most)).cast("bigint"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES, seed: int = 42,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", rank_weight: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A source asked for r times its words gives every document floor(r) whole copies. The rest is a sample
    of fixed size without repetition: documents are ranked by Pareto's order, odds of a random number over
    odds of inclusion, and taken in that order until the words come nearest to the target. ``rank_weight``
    names a column of relative inclusion weights; without it a document's weight is the number of binary digits
    of its size, one more for each doubling, so that longer documents are the likelier ones. Weights are
    scaled so that the words expected are those still missing; a chance beyond 1 is a document taken first.

    Size counts words; null texts have 0. A null source is a source, the last. A source without words has
    target 0 and gives nothing. Repeated rows share their fate; reruns agree. Columns not named are not
    read. No source is sorted in one place: the last document taken is found by sums over ever finer ranks.
    """
    rows = settle(_prepared(docs, doc_id, text, source, rank_weight).select(*_PREPARED), "sizes")
    out = _with_copies(rows, plan(rows, weights, share, most, seed), seed, most)
    return out.select(F.col("__llm_id").alias("doc_id"), F.col("__llm_size").alias("size"), "source_size", "target",
                      (F.col("__llm_size") * F.col("__llm_copies")).alias("taken"), F.col("__llm_copies").alias("copies"))


def repeat(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES, seed: int = 42,
           doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with all its columns."""
    rows = _prepared(docs, doc_id, text, source, None)
    planned = plan(settle(rows.select(*_PREPARED), "sizes"), weights, share, most, seed)
    # Put away whole: the plan's names could be those of columns of the documents.
    own = rows.select(*_PREPARED, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__llm_row"))
    out = _with_copies(own, planned, seed, most).where("__llm_copies > 0")
    return out.select("__llm_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__llm_copies")))).select("__llm_row.*")
