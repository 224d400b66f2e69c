"""Row counts per table and their comparison; work on many tables in a bounded pool."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.operators.reconcile import checksum_of, reconcile
from keepsake.sources.storage import load_named

LOG = logging.getLogger(__name__)


def per_table(spark: SparkSession, names: list[str], work: Callable[[str], dict], parallel: int) -> list[dict]:
    """Run ``work`` for every table; an error of one table becomes its result and stops no other."""

    def guarded(name: str) -> dict:
        try:
            return {"table_name": name, "error": None, **{k: v for k, v in work(name).items() if k != "error"}}
        except Exception as exc:
            return {"table_name": name, "error": f"{type(exc).__name__}: {exc}"}

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(guarded), names))


def read_parts(spark: SparkSession, parts: list[str], fmt: str, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """One table from its full copy and increments, and its partition columns, whose values are folder names."""
    table, layout = None, []
    for part in parts:
        rows, kinds = load_named(spark, part, fmt, schema)
        if table is not None and list(kinds) != layout:
            raise ValueError(f"{part} is partitioned by {list(kinds)}, {parts[0]} by {layout}")
        table, layout = (rows if table is None else table.unionByName(rows)), list(kinds)
    return table, layout


COUNTS = "table_name string, rows bigint, checksum string, error string"


def count_frames(spark: SparkSession, frames: dict[str, Callable[[], DataFrame]], parallel: int = 4, content: bool = False) -> DataFrame:
    """``table_name, rows, checksum, error``; a count without checksum reads no columns.

    All tables are counted in one job. If it fails, its halves are tried, so that a few tables that cannot be read
    cost a few jobs more, and the others are still counted together.
    """

    def counted(name: str) -> DataFrame:
        table = frames[name]()
        checksum = checksum_of(table) if content else F.lit(None).cast("string")
        return table.agg(F.count(F.lit(1)).alias("rows"), checksum.alias("checksum")).select(
            F.lit(name).alias("table_name"), "rows", "checksum", F.lit(None).cast("string").alias("error"))

    def together(names: list[str]) -> list:
        try:
            result = spark.createDataFrame([], COUNTS)
            for name in names:
                result = result.unionByName(counted(name))
            return result.collect()
        except Exception as exc:
            if len(names) == 1:
                return [(names[0], None, None, f"{type(exc).__name__}: {exc}")]
            LOG.warning("counting %d tables together failed, trying their halves: %s", len(names), str(exc).split("\n", 1)[0])
            half = len(names) // 2
            with ThreadPoolExecutor(max_workers=min(parallel, 2)) as pool:
                return [row for rows in pool.map(inheritable_thread_target(spark)(together), (names[:half], names[half:])) for row in rows]

    return spark.createDataFrame(together(sorted(frames)) if frames else [], COUNTS)


def count_tables(spark: SparkSession, tables: dict[str, list[str]], fmt: str, parallel: int = 4, content: bool = False,
                 schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    """``count_frames`` of tables by the folders that make them up."""
    frames = {name: lambda name=name: read_parts(spark, tables[name], fmt, (schemas or {}).get(name))[0] for name in tables}
    return count_frames(spark, frames, parallel, content)


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """VERIFY rows from two results of ``count_tables``; read errors and checksums are compared too."""
    counts = reconcile(source.where("rows IS NOT NULL"), copy.where("rows IS NOT NULL"), ["table_name"])
    sums = source.select("table_name", F.col("checksum").alias("_c1"), F.col("error").alias("_e1")).join(
        copy.select("table_name", F.col("checksum").alias("_c2"), F.col("error").alias("_e2")), "table_name", "full_outer")
    both = sums.join(counts, "table_name", "left")
    differs = F.coalesce(F.col("_c1") != F.col("_c2"), F.lit(False))
    return both.select(
        "table_name", "source_rows", "backup_rows",
        (F.coalesce("verified", F.lit(False)) & ~differs).alias("verified"),
        F.coalesce(F.col("_e1"), F.col("_e2"), F.col("error"), F.when(differs, F.lit("content differs"))).alias("error"))


def verify_chain(copies: DataFrame, chains: DataFrame, sources: DataFrame) -> DataFrame:
    """``verify_copy`` rows with ``total_rows`` (of the whole chain) and ``source_total_rows`` (of the source up to the mark).

    Row hashes add up, so the sum of all parts of a chain is the sum of the table they make up: a row that an
    increment lost, doubled or never saw makes the two differ.
    """
    ours = chains.select("table_name", F.col("rows").alias("total_rows"), F.col("checksum").alias("_c1"))
    theirs = sources.select("table_name", F.col("rows").alias("source_total_rows"), F.col("checksum").alias("_c2"), F.col("error").alias("_e2"))
    both = copies.join(ours.join(theirs, "table_name"), "table_name", "left")
    problem = (F.when(F.col("_e2").isNotNull(), F.col("_e2"))
               .when(F.col("total_rows") != F.col("source_total_rows"), F.lit("the chain and the source up to its mark differ in rows"))
               .when(F.col("_c1") != F.col("_c2"), F.lit("the chain and the source up to its mark differ in content")))
    return both.select("table_name", "source_rows", "backup_rows", (F.col("verified") & problem.isNull()).alias("verified"),
                       F.coalesce("error", problem).alias("error"), "total_rows", "source_total_rows")


def backup_integrity(spark: SparkSession, tables: dict[str, list[str]], fmt: str, parallel: int = 4) -> tuple[bool, DataFrame]:
    """Every table loads and every value of it can be read; errors captured."""
    counts = count_tables(spark, tables, fmt, parallel, content=True)
    return counts.where("error IS NOT NULL").isEmpty(), counts
