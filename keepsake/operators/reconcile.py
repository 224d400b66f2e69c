"""Comparing two sides: row counts per table, sets of tables, changed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reconcile(source: DataFrame, copy: DataFrame, keys: list[str]) -> DataFrame:
    """Join row counts of source and copy: ``keys, source_rows, backup_rows, verified, error``.

    A table missing on one side is a failure with an error text.
    """
    both = source.select(*keys, F.col("rows").alias("source_rows")).join(
        copy.select(*keys, F.col("rows").alias("backup_rows")), keys, "full_outer")
    error = (F.when(F.col("source_rows").isNull(), F.lit("missing in source"))
             .when(F.col("backup_rows").isNull(), F.lit("missing in backup"))
             .when(F.col("source_rows") != F.col("backup_rows"), F.lit("row counts differ")))
    verified = F.coalesce(F.col("source_rows") == F.col("backup_rows"), F.lit(False))
    return both.select(*keys, "source_rows", "backup_rows", verified.alias("verified"), error.alias("error"))


def all_verified(verification: DataFrame, keys: list[str]) -> DataFrame:
    """Logical AND per group and the counts behind it; a group without tables is verified."""
    return verification.groupBy(*keys).agg(
        F.coalesce(F.bool_and("verified"), F.lit(True)).alias("all_verified"),
        F.count(F.lit(1)).alias("tables"),
        F.count_if(~F.col("verified")).alias("failed"),
        F.coalesce(F.sum("source_rows"), F.lit(0).cast("bigint")).alias("expected_rows"),
        F.coalesce(F.sum("backup_rows"), F.lit(0).cast("bigint")).alias("copied_rows"),
    )


def quality_scores(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Share of backups that pass, and share of the expected rows that were copied, in percent."""
    passed = F.sum(F.col("all_verified").cast("bigint")) * 100.0 / F.count(F.lit(1))
    copied = F.sum("copied_rows") * 100.0 / F.nullif(F.sum("expected_rows"), F.lit(0))
    return rollup.groupBy(*keys).agg(
        F.round(passed, 6).alias("backup_integrity_score"),
        F.round(copied, 6).alias("data_completeness_score"),
        (passed < 99.5).alias("integrity_alert"),
        (copied < 99.5).alias("completeness_alert"),
    )


def compare_tables(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Every table of two backups with where it is: common, only_in_first, only_in_second.

    One row per table, so a backup with very many tables is never gathered in one place.
    """
    left = first.select(*keys, "table_name").distinct().withColumn("_1", F.lit(True))
    right = second.select(*keys, "table_name").distinct().withColumn("_2", F.lit(True))
    place = (F.when(F.col("_2").isNull(), F.lit("only_in_first"))
             .when(F.col("_1").isNull(), F.lit("only_in_second")).otherwise(F.lit("common")))
    return left.join(right, keys + ["table_name"], "full_outer").select(*keys, "table_name", place.alias("place"))


def restored_tables(requested: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Requested minus failed."""
    return requested.join(failed.select(*keys).distinct(), keys, "left_anti")


def _with_nulls(column: Column, kind: T.DataType) -> Column:
    """A value whose hash also says where its nulls are, and which can be hashed whatever it holds."""
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        # Keys can always be put in order, values such as maps cannot.
        entries = F.transform(F.array_sort(F.map_keys(column)), lambda k: F.struct(k.alias("key"), column[k].alias("value")))
        return _with_nulls(entries, T.ArrayType(entry))
    if isinstance(kind, T.ArrayType):
        plain = not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType))
        nulls = F.transform(column, lambda x: x.isNull())
        values = column if plain else F.transform(column, lambda x: _with_nulls(x, kind.elementType))
        return F.struct(column.isNull().alias("none"), nulls.alias("nulls"), values.alias("value"))
    if isinstance(kind, T.StructType):
        parts = [_with_nulls(column[field.name], field.dataType).alias(f"f{i}") for i, field in enumerate(kind.fields)]
        return F.struct(column.isNull().alias("none"), *parts)
    # A column that was widened between two copies hashes as before.
    wide = "bigint" if isinstance(kind, T.IntegralType) else "double" if isinstance(kind, T.FloatType) else None
    return F.struct(column.isNull().alias("none"), (column.cast(wide) if wide else column).alias("value"))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row: of its values and of where its nulls are, at any depth. The order of columns does not matter."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.xxhash64(*[_with_nulls(F.col(f"`{field.name}`"), field.dataType) for field in fields])


def checksum_of(df: DataFrame) -> Column:
    """Aggregate: an order-independent sum of row hashes, as text."""
    return F.coalesce(F.sum(row_hash(df).cast("decimal(20,0)")), F.lit(0)).cast("string")


def portable_checksum(df: DataFrame) -> DataFrame:
    """One row: number of rows and a checksum that any SQL engine can compute.

    A row's text joins its fields: null is ~, a fraction counts in millionths rounded down, a time in
    microseconds, an array is its elements joined by commas. The checksum sums the first 32 bits of
    the MD5 of each row's text.
    """

    def text(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.floor(column.cast("double") * 1_000_000)
        elif isinstance(kind, T.TimestampNTZType):
            column = F.unix_micros(column.cast("timestamp"))
        elif isinstance(kind, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(F.transform(column, lambda x: text(x, kind.elementType)), ",")
        return F.coalesce(column.cast("string"), F.lit("~"))

    whole = F.concat_ws("|", *[text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    part = F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0).cast("bigint")).alias("checksum"))


def content_checksum(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-independent sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("rows"), checksum_of(df).alias("checksum"))


def rows_after(df: DataFrame, column: str, mark: Column | None) -> DataFrame:
    """Rows past a stored high-water mark; the comparison reaches the file scan. All rows without one."""
    return df if mark is None else df.where(F.col(column) > mark)


def changed_rows(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new, or differ from the earlier copy, by key and row hash.

    Only keys and hashes of the earlier copy are shuffled. Deleted rows are not found.
    """
    known = previous.select(*keys, row_hash(previous).alias("_hash"))
    return current.withColumn("_hash", row_hash(current)).join(known, keys + ["_hash"], "left_anti").drop("_hash")


def sample_for_test(catalog: DataFrame, percent: float, seed: str) -> DataFrame:
    """A random share of backups for a restore test.

    Drawn from a hash of the folder name, so that a retried task draws the same backups.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.col("folder_name"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return catalog.where(draw < int(percent / 100 * 2**32))
