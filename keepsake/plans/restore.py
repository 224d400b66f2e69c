"""Restore tables from a backup, list and compare backups."""

from __future__ import annotations

import datetime as dt
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keepsake.functions.patterns import parse_list
from keepsake.operators.reconcile import compare_tables, sample_for_test
from keepsake.options import RestoreOptions
from keepsake.plans.backup import RunResult
from keepsake.plans.discover import discover
from keepsake.plans.verify import COUNTS, backup_integrity, count_tables, per_table, read_parts, verify_copy
from keepsake.schemas import TABLE_METADATA
from keepsake.session import settle
from keepsake.sources import manifests
from keepsake.sources.storage import DriverFiles, is_data, list_below, list_tables, open_path, qualified, table_of


def chosen_tables(spark: SparkSession, options: RestoreOptions) -> list[str]:
    """The explicit list if it names any table, else the manifest's, else the visible folders."""
    wanted = parse_list(options.tables)
    if wanted:
        return wanted
    manifest = manifests.read_manifest(spark, options.source)
    if manifest is not None and manifest.tables is not None:
        return list(manifest.tables)
    return sorted(list_tables(spark, options.source))


def table_parts(spark: SparkSession, backup_path: str, tables: list[str]) -> dict[str, list[str]]:
    """Folders that make up each table, oldest first.

    The manifest says of each copy whether it is whole or holds the rows between two marks. A partial
    copy needs the copies before it, each ending at the mark where the next begins, down to a whole one.
    Raises if any of them is missing or does not fit.
    """
    path = backup_path.rstrip("/")
    manifest = manifests.read_manifest(spark, path)
    chain = list(manifest.chain or []) if manifest is not None else []
    location, below = posixpath.dirname(path), {}
    # A copy without manifest may lie in a folder or file named <table>.parquet.
    found = list_tables(spark, path)
    if chain:
        below = {row.folder_name: row.manifest for row in manifests.read_manifests(spark, [location])
                 .where(F.col("folder_name").isin(chain)).collect()}
    parts = {}
    for name in tables:
        copy = manifests.copies_of(manifest).get(name)
        if copy is None and name in ((manifest.high_water_marks or {}) if chain else {}):
            raise ValueError(f"{path}: the manifest does not say how {name} was copied")
        parts[name] = [f"{path}/{name}" if copy is not None else found.get(name, f"{path}/{name}")]
        for folder in reversed(chain):
            if copy is None or copy.kind == "whole":
                break
            if folder not in below:
                raise ValueError(f"{path} builds on {folder}, which is missing")
            before = manifests.copies_of(below[folder]).get(name)
            if before is None or before.kind == "missing":
                continue
            if copy.low != before.high:
                raise ValueError(f"{path}: {name} goes on from {copy.low}, but {folder} ends at {before.high}")
            parts[name].insert(0, f"{location}/{folder}/{name}")
            copy = before
        if copy is not None and copy.kind != "whole":
            raise ValueError(f"{path}: no whole copy of {name} in its chain")
    return parts


def restore(spark: SparkSession, options: RestoreOptions) -> RunResult:
    """Restore into ``options.target``. Nothing is written if a table to restore cannot be read.

    Each table is written beside the target and moved into place when complete, so a failed copy
    leaves the old table as it was. The old table is put aside until the new one is in place; if it
    cannot be put back either, it stays there and the error says where.
    """
    began = dt.datetime.now()
    files = DriverFiles(spark)
    source, target = options.source.rstrip("/"), options.target.rstrip("/")
    if not files.exists(source):
        raise ValueError(f"backup {source} does not exist")
    names = chosen_tables(spark, options)
    parts = table_parts(spark, source, names)

    if options.validate_before:
        valid, counts = backup_integrity(spark, parts, options.fmt, options.parallel_tables)
        if not valid:
            bad = sorted(row.table_name for row in counts.where("error IS NOT NULL").collect())
            return RunResult("failed", target, [], bad, message="backup is not intact")

    run = uuid.uuid4().hex[:8]
    staging = f"{target}/.restoring-{run}"

    def copy(name: str) -> dict:
        final = f"{target}/{name}"
        there = files.exists(final)
        if there and not options.overwrite:
            return {"skipped": True}
        rows, layout = read_parts(spark, parts[name], options.fmt)
        writer = rows.write.format(options.fmt).mode("overwrite")
        (writer.partitionBy(*layout) if layout else writer).save(f"{staging}/{name}")
        old = f"{target}/.old-{run}-{name}"
        if there:
            files.move(final, old)
        try:
            files.move(f"{staging}/{name}", final)
        except Exception as failure:
            if there:
                try:
                    files.move(old, final)
                except Exception as stuck:
                    raise OSError(f"{final} could not be replaced ({failure}); the old table is kept at {old}") from stuck
            raise
        if there:
            files.remove(old)
        return {"skipped": False}

    results = per_table(spark, names, copy, options.parallel_tables)
    files.remove(staging)
    done = [r["table_name"] for r in results if r["error"] is None and not r["skipped"]]
    skipped = [r["table_name"] for r in results if r["error"] is None and r["skipped"]]
    failed = [r["table_name"] for r in results if r["error"] is not None]

    passed = None
    if options.verify_after and done:
        # What the manifest promises; parts are counted only for backups whose manifest does not say.
        said = manifests.copies_of(manifests.read_manifest(spark, source))
        promised = [(n, said[n].total_rows, said[n].total_checksum, None) for n in done if n in said]
        expected = spark.createDataFrame(promised, COUNTS)
        if len(promised) < len(done):
            expected = expected.union(count_tables(spark, {n: parts[n] for n in done if n not in said}, options.fmt, options.parallel_tables))
        content = any(checksum is not None for _, _, checksum, _ in promised)
        actual = count_tables(spark, {n: [f"{target}/{n}"] for n in done}, options.fmt, options.parallel_tables, content)
        passed = verify_copy(expected, actual).where("NOT verified").isEmpty()
    if options.include_logs and done:
        restore_metadata(spark, source, target, done)
    status = "success" if not failed else "partial_success" if done or skipped else "failed"
    if passed is False:
        status = "partial_success" if status == "success" else status
    return RunResult(status, target, done, failed, skipped, duration_seconds=(dt.datetime.now() - began).total_seconds(),
                     verification_passed=passed, message="; ".join(r["error"] for r in results if r["error"]))


def restore_metadata(spark: SparkSession, source: str, target: str, tables: list[str]) -> None:
    """Put the schema and origin of the restored tables, where the backup has them, into the target's table metadata."""
    if not DriverFiles(spark).exists(f"{source}/_table_metadata"):
        return
    rows = spark.read.schema(TABLE_METADATA).json(f"{source}/_table_metadata").where(F.col("table_name").isin(tables)).collect()
    if DriverFiles(spark).exists(f"{target}/_table_metadata"):
        # One row per table: what was restored before is replaced.
        fresh = {row.table_name for row in rows}
        rows += [row for row in spark.read.schema(TABLE_METADATA).json(f"{target}/_table_metadata").collect() if row.table_name not in fresh]
    spark.createDataFrame(rows, TABLE_METADATA).coalesce(1).write.mode("overwrite").json(f"{target}/_table_metadata")


def _parts_of(tested: DataFrame, known: DataFrame) -> DataFrame:
    """``table_parts`` of many backups at once: full_path, table_name, location, part_folder, error.

    ``tested`` has location, folder_name, full_path, manifest and table_name; ``known`` all manifests of the locations.
    """
    def copy_of(manifest: Column) -> Column:
        return F.get(F.filter(manifest["copies"], lambda c: c["table_name"] == F.col("table_name")), 0)

    chain = F.coalesce(F.col("manifest.chain"), F.array().cast("array<string>"))
    marked = F.coalesce(F.array_contains(F.map_keys("manifest.high_water_marks"), F.col("table_name")), F.lit(False))
    own = tested.withColumns({"chain": chain, "copy": copy_of(F.col("manifest"))})
    unsaid = F.col("copy").isNull() & (F.size("chain") > 0) & marked
    first = own.select("full_path", "table_name", "location", F.col("folder_name").alias("part_folder"),
                       F.when(unsaid, F.lit("the manifest does not say how the table was copied")).alias("error"))

    partial = own.where("copy IS NOT NULL AND copy.kind <> 'whole'")
    steps = partial.select("full_path", "table_name", "location", F.col("copy.low").alias("low"), F.posexplode_outer(F.reverse("chain")).alias("pos", "part_folder"))
    below = known.select("location", F.col("folder_name").alias("part_folder"), F.col("manifest").alias("below"))
    steps = steps.join(below, ["location", "part_folder"], "left").withColumn("before", copy_of(F.col("below")))
    table = W.partitionBy("full_path", "table_name")
    steps = steps.withColumn("last", F.min(F.when(F.col("before.kind") == "whole", F.col("pos"))).over(table))
    steps = steps.where("last IS NULL OR pos <= last").where("below IS NULL OR before.kind <> 'missing'")
    goes_on = F.coalesce(F.lag("before.low").over(table.orderBy("pos")), F.col("low")).eqNullSafe(F.col("before.high"))
    problem = (F.when(F.col("part_folder").isNotNull() & F.col("below").isNull(), F.concat(F.lit("builds on a missing backup: "), "part_folder"))
               .when(F.col("last").isNull(), F.lit("no whole copy of the table in its chain"))
               .when(~goes_on, F.concat(F.lit("does not go on where it ends: "), "part_folder")))
    return first.unionByName(steps.select("full_path", "table_name", "location", "part_folder", problem.alias("error")))


# Bytes read ahead in each column, and bytes and rows decoded at once: a task's memory does not grow with files or row groups.
READ_AHEAD = 1 << 18
BATCH_BYTES = 1 << 23
BATCH_ROWS = 8192


def _read_files(before: dict[str, str]):
    """Function for mapInPandas: reads every value of Parquet files, a bounded number of bytes at a time."""

    def read(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for location, path in zip(batch["location"], batch["path"]):
                rows, error = 0, None
                try:
                    system, inner = open_path(path, before[location])
                    with system.open_input_file(inner) as file:
                        # Without a buffer the reader holds whole columns of a row group.
                        parquet = pq.ParquetFile(file, buffer_size=READ_AHEAD, pre_buffer=False)
                        groups = [parquet.metadata.row_group(i) for i in range(parquet.num_row_groups)]
                        widest = max((g.total_byte_size / max(g.num_rows, 1) for g in groups), default=0)
                        for part in parquet.iter_batches(max(1, min(BATCH_ROWS, int(BATCH_BYTES / max(widest, 1)))), use_threads=False):
                            rows += len(part)
                except Exception as exc:
                    error = f"{path}: {exc}"
                found.append((rows, error))
            yield batch.assign(rows=pd.Series([r for r, _ in found], dtype="int64"), error=pd.Series([e for _, e in found], dtype="object"))

    return read


def sampled_restore_test(spark: SparkSession, catalog: DataFrame, percent: float, seed: str) -> DataFrame:
    """Restore test of a repeatable random share of Parquet backups: ``full_path, valid, tables, rows, error``.

    Every table's parts are found as a restore finds them, and every value in their files is read. Which backups, parts
    and files these are stays in DataFrames: the files of all sampled backups are read by one job, a file that several
    chains share once, so the number of jobs does not grow with the sample. A backup without manifest has the tables
    that its visible folders name. A part without files is an error; a backup without tables is valid.
    """
    locations = [row.location for row in catalog.select("location").distinct().collect()]
    chosen = settle(sample_for_test(catalog, percent, seed).select("location", "folder_name", "full_path"), "sampled")
    known = manifests.all_manifests(spark, locations, chosen.select("location", "folder_name", F.col("full_path").alias("path")))
    own = settle(chosen.join(known, ["location", "folder_name"], "left"), "tested")

    said = own.where("manifest.tables IS NOT NULL").withColumn("table_name", F.explode("manifest.tables"))
    path = F.concat_ws("/", "location", "folder_name")
    plain = own.where("manifest.tables IS NULL").select("location", "folder_name", path.alias("path"))
    visible = list_below(plain, locations).select("location", "folder_name", table_of("path").alias("table_name")).distinct().where(
        ~F.rlike("table_name", F.lit("^[_.]")))
    tested = said.unionByName(own.where("manifest.tables IS NULL").join(visible, ["location", "folder_name"]))
    parts = settle(_parts_of(tested, known), "parts")

    folders = parts.where("part_folder IS NOT NULL").select("location", F.col("part_folder").alias("folder_name"), "table_name").distinct()
    files = list_below(folders.select("location", "folder_name", F.concat_ws("/", "location", "folder_name", "table_name").alias("path")), locations)
    data = settle(files.where(is_data("path") | F.col("error").isNotNull()).select("location", "folder_name", table_of("path").alias("table_name"), "path", "error"), "files")
    spread = data.where("error IS NULL").drop("error").repartition(spark.sparkContext.defaultParallelism * 4, "path")
    read = spread.mapInPandas(_read_files(qualified(spark, locations)), "location string, folder_name string, table_name string, path string, rows bigint, error string")
    unread = data.where("error IS NOT NULL").withColumn("rows", F.lit(0).cast("bigint"))
    held = settle(read.unionByName(unread), "held").groupBy("location", F.col("folder_name").alias("part_folder"), "table_name").agg(
        F.sum("rows").alias("rows"), F.min("error").alias("unread"))
    whole = parts.join(held, ["location", "part_folder", "table_name"], "left")
    nothing = F.when(F.col("rows").isNull(), F.concat(F.lit("no files of "), "table_name", F.lit(" in "), F.coalesce("part_folder", F.lit("its chain"))))
    result = whole.groupBy("full_path").agg(F.count_distinct("table_name").alias("tables"), F.sum("rows").alias("rows"),
                                            F.coalesce(F.min("error"), F.min("unread"), F.min(nothing)).alias("error"))
    return chosen.select("full_path").join(result, "full_path", "left").select(
        "full_path", F.col("error").isNull().alias("valid"), F.coalesce("tables", F.lit(0).cast("bigint")).alias("tables"), "rows", "error")


def list_backups(spark: SparkSession, location: str, as_of: dt.datetime | str) -> DataFrame:
    """Backups of a location with what their manifests say; Unknown where there is none."""
    catalog, _ = discover(spark, [location], as_of)
    manifest = F.col("manifest")
    return catalog.select(
        "folder_name", "full_path", F.coalesce(manifest["backup_timestamp"], F.lit("Unknown")).alias("backup_timestamp"),
        "source_lakehouse", "tables_count", F.coalesce(manifest["backup_size_bytes"], F.lit(0)).alias("backup_size_bytes"),
        F.when(manifest.isNull(), F.lit("manifest not readable")).alias("error"))


def backup_tables(spark: SparkSession, path: str) -> DataFrame:
    """Table names of one backup: from the manifest, else the visible folders."""
    manifest = manifests.read_manifest(spark, path)
    names = manifest.tables if manifest is not None and manifest.tables is not None else sorted(list_tables(spark, path))
    return spark.createDataFrame([(name,) for name in names], "table_name string")


def compare_backups(spark: SparkSession, first: str, second: str) -> DataFrame:
    """One row per table with its place: common, only_in_first, only_in_second; sorted by name."""
    return compare_tables(backup_tables(spark, first), backup_tables(spark, second), []).orderBy("place", "table_name")
