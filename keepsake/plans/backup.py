"""Copy the tables of a lakehouse to a backup folder: full, incremental or differential."""

from __future__ import annotations

import datetime as dt
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake import __name__ as ENGINE
from keepsake.functions.marks import mark_fits, mark_text, mark_value
from keepsake.functions.names import folder_timestamp, new_backup_folder
from keepsake.functions.patterns import glob_regex, parse_list
from keepsake.functions.periods import age_days, as_of_column
from keepsake.operators.reconcile import checksum_of, rows_after
from keepsake.operators.retention import simple_retention, without_needed
from keepsake.options import BackupOptions
from keepsake.plans.verify import COUNTS, count_frames, count_tables, per_table, verify_chain, verify_copy
from keepsake.schemas import LOG, TABLE_METADATA
from keepsake.session import settle
from keepsake.sources import manifests
from keepsake.sources.storage import (
    CATALOG_PREFIX, delete_paths, list_catalog_tables, list_tables, list_tree, load_named, quoted, table_sizes, top_folders, with_names, with_types)

LAYOUT = "%Y-%m-%d %H:%M:%S"


@dataclass
class RunResult:
    status: str
    path: str = ""
    tables: list = field(default_factory=list)
    failed: list = field(default_factory=list)
    skipped: list = field(default_factory=list)
    files_count: int = 0
    size_bytes: int = 0
    duration_seconds: float = 0.0
    verification_passed: bool | None = None
    message: str = ""


class RunLog:
    """Log rows of one job, written once at its end."""

    def __init__(self, clock=dt.datetime.now):
        self._clock = clock
        self.rows: list[tuple] = []

    def add(self, message: str, level: str = "INFO") -> None:
        self.rows.append((self._clock().replace(microsecond=0), level, message))

    def write(self, spark: SparkSession, path: str, mode: str, fmt: str = "parquet") -> None:
        if self.rows:
            spark.createDataFrame(self.rows, LOG).coalesce(1).write.format(fmt).mode(mode).save(path)


def matching_tables(tables: dict[str, str], text: str) -> dict[str, str]:
    """Tables whose name matches a comma-separated list of patterns."""
    wanted = parse_list(text)
    if not wanted:
        return tables
    form = re.compile(glob_regex(wanted))
    return {name: path for name, path in tables.items() if form.match(name)}


def parent_backup(spark: SparkSession, destination: str, source_name: str, mode: str):
    """(folder, manifest) that an increment builds on: the latest backup, or the latest full one.

    Only backups with a manifest, of the same lakehouse, with a copied table and not failed in
    verification, count.
    """
    usable = manifests.read_manifests(spark, [destination]).where(
        (F.col("manifest.source_lakehouse_name") == source_name)
        & F.coalesce(F.col("manifest.verification_passed"), F.lit(True)) & (F.size("manifest.tables") > 0)
        & folder_timestamp(F.col("folder_name")).isNotNull())
    if mode == "differential":
        usable = usable.where("manifest.backup_mode = 'full'")
    last = usable.orderBy(folder_timestamp(F.col("folder_name")).desc(), "folder_name").limit(1).collect()
    return (last[0].folder_name, last[0].manifest) if last else (None, None)


@dataclass
class _Copy:
    """What to copy of one table: all its rows, or those past a mark; and the mark that the copied rows reach."""

    rows: DataFrame
    kinds: dict[str, T.DataType]
    kind: str = "whole"
    low: str | None = None
    reached: Column | None = None


def _source(spark: SparkSession, name: str, path: str, options: BackupOptions) -> tuple[DataFrame, dict[str, T.DataType]]:
    """The table with the partition filter, typed, and its partition columns. A filter that does not apply to a
    table it is meant for raises; filters reach the file scan."""
    named, kinds = load_named(spark, path, options.fmt)
    table = with_types(named, kinds)
    if options.partition_filter and (not options.partition_filter_tables or name in options.partition_filter_tables):
        table = table.where(options.partition_filter)
    return table, kinds


def _copy_plan(spark: SparkSession, name: str, path: str, options: BackupOptions, old_mark: str | None, log: RunLog) -> _Copy:
    table, kinds = _source(spark, name, path, options)
    column = options.high_water_columns.get(name)
    if column is None:
        return _Copy(table, kinds)
    kind = table.schema[column].dataType
    # The mark is the largest value among the very rows that are written, observed as they are: rows that
    # come later are past it, and nothing is read twice.
    reached = mark_text(F.max(F.col(column).cast(kind)), kind)
    if old_mark is not None and not mark_fits(old_mark, kind):
        log.add(f"{name}: the mark {old_mark} does not fit {column} of type {kind.simpleString()}, copying the whole table", "WARNING")
    elif old_mark is not None and not table.where(F.col(column).isNull()).isEmpty():
        log.add(f"{name}: some rows have no {column}, copying the whole table", "WARNING")
    elif old_mark is not None:
        return _Copy(rows_after(table, column, mark_value(old_mark)), kinds, "partial", old_mark, reached)
    return _Copy(table, kinds, reached=reached)


def _up_to(spark: SparkSession, name: str, path: str, options: BackupOptions, mark: str | None) -> DataFrame:
    """Rows of the source as it is now that a copy reaching ``mark`` stands for."""
    table, kinds = _source(spark, name, path, options)
    column = F.col(options.high_water_columns[name])
    reached = column.isNull() if mark is None else column.isNull() | (column <= mark_value(mark))
    return with_names(table.where(reached), kinds)


def backup(spark: SparkSession, source: str, options: BackupOptions, at: dt.datetime | None = None,
           tables: dict[str, str] | None = None) -> RunResult:
    """Back up every table below ``source``. The manifest is written last: a folder without one is
    incomplete. One table's failure is recorded and the others go on."""
    began = dt.datetime.now()
    start = at or began
    log = RunLog()
    destination = options.destination.rstrip("/")
    folder = options.backup_folder or new_backup_folder(start)
    path = posixpath.join(destination, folder)
    tables = tables or list_tables(spark, source)
    if not tables and source.rstrip("/").split("/")[-1] == "Tables":
        log.add("folder listing is empty, taking the tables of the session catalog")
        tables = {name: f"{CATALOG_PREFIX}{quoted(name)}" for name in list_catalog_tables(spark)}
    tables = matching_tables(tables, options.table_filter)
    log.add(f"backing up {len(tables)} tables from {source} to {path}")

    parent, parent_manifest = (None, None)
    if options.mode != "full":
        parent, parent_manifest = parent_backup(spark, destination, options.source_name, options.mode)
        if parent is None:
            log.add("no earlier backup to build on, making a full one", "WARNING")
    mode = options.mode if parent else "full"
    old_marks = dict(parent_manifest.high_water_marks or {}) if parent else {}
    earlier = manifests.copies_of(parent_manifest) if parent else {}
    schemas: dict[str, T.StructType] = {}

    def copy(name: str) -> dict:
        # A mark counts only where the parent says how many rows stand behind it.
        old_mark = old_marks.get(name) if name in earlier else None
        plan = _copy_plan(spark, name, tables[name], options, old_mark, log)
        # Rows and checksum of the source are taken from the very rows that are written.
        seen, rows = Observation(), with_names(plan.rows, plan.kinds)
        wanted = [F.count(F.lit(1)).alias("rows")] + ([plan.reached.alias("mark")] if plan.reached is not None else [])
        if options.content_check:
            wanted.append(checksum_of(rows).alias("checksum"))
        writer = rows.observe(seen, *wanted).write.format(options.fmt).mode("overwrite")
        if options.compress:
            writer = writer.option("compression", "snappy")
        layout = options.partition_columns.get(name) or list(plan.kinds)
        if layout:
            writer = writer.partitionBy(*layout)
        writer.save(f"{path}/{name}")
        # A plan that Spark knows to be empty runs no job and reports nothing.
        found = seen.get
        count = found.get("rows", 0)
        checksum = found.get("checksum", "0") if options.content_check else None
        high = found.get("mark")
        total, total_checksum = count, checksum
        if plan.kind == "partial":
            before = earlier[name]
            total, high = count + before.total_rows, high or plan.low
            total_checksum = str(int(checksum) + int(before.total_checksum)) if checksum and before.total_checksum else None
        schemas[name] = T.StructType([T.StructField(f.name, plan.kinds.get(f.name, f.dataType), f.nullable) for f in rows.schema.fields])
        return {"kind": plan.kind, "low": plan.low, "high": high, "rows": count, "total_rows": total, "checksum": checksum,
                "total_checksum": total_checksum, "layout": layout}

    results = per_table(spark, sorted(tables), copy, options.parallel_tables)
    done = [r for r in results if r["error"] is None]
    failed = [r for r in results if r["error"] is not None]
    for r in results:
        log.add(f"{r['table_name']}: {r['error'] or 'copied'}", "ERROR" if r["error"] else "INFO")

    if options.include_logs and done:
        # Schema and origin of each table. A live transaction log is never copied over the new files.
        spark.createDataFrame(
            [(r["table_name"], schemas[r["table_name"]].json(), options.fmt, tables[r["table_name"]]) for r in done],
            TABLE_METADATA,
        ).coalesce(1).write.mode("overwrite").json(f"{path}/_table_metadata")

    files_count, size_bytes = 0, 0
    if done:
        total = table_sizes(list_tree(spark, [path])).agg(F.sum("num_files"), F.sum("size_bytes")).first()
        files_count, size_bytes = total[0] or 0, total[1] or 0

    passed = None
    if options.verify and done:
        written = spark.createDataFrame([(r["table_name"], r["rows"], r["checksum"], None) for r in done], COUNTS)
        # Partitioned copies get their column order from the files, so their schema is looked up.
        known = {r["table_name"]: schemas[r["table_name"]] for r in done if options.fmt == "parquet" and not r["layout"]}
        copied = count_tables(spark, {r["table_name"]: [f"{path}/{r['table_name']}"] for r in done}, options.fmt, options.parallel_tables,
                              options.content_check, known)
        # A chain is compared with the source, not with what it was asked to copy.
        grown = [r for r in done if r["kind"] == "partial"]
        chains = spark.createDataFrame([(r["table_name"], r["total_rows"], r["total_checksum"], None) for r in grown], COUNTS)
        sources = count_frames(spark, {r["table_name"]: lambda r=r: _up_to(spark, r["table_name"], tables[r["table_name"]], options, r["high"]) for r in grown},
                               options.parallel_tables, options.content_check)
        passed = write_verification(spark, verify_chain(verify_copy(written, copied), chains, sources), path)
        log.add(f"verification {'passed' if passed else 'failed'}", "INFO" if passed else "ERROR")

    end = start + (dt.datetime.now() - began)
    manifests.write_manifest(spark, path, {
        "backup_id": folder.split("_")[-1], "backup_timestamp": start.strftime(LAYOUT),
        "source_lakehouse_name": options.source_name, "source_workspace_id": options.source_workspace_id,
        "backup_type": options.backup_type, "tables": [r["table_name"] for r in done], "files_count": files_count,
        "backup_size_bytes": size_bytes, "include_delta_logs": options.include_logs, "compressed": options.compress,
        "start_time": start.strftime(LAYOUT), "end_time": end.strftime(LAYOUT),
        "duration_seconds": float(int((end - start).total_seconds())), "fabric_version": ENGINE,
        "verification_passed": passed, "backup_mode": mode, "parent_folder": parent,
        "chain": [*(parent_manifest.chain or []), parent] if parent else [],
        # Marks of tables that failed now are carried on: the next increment starts there.
        "high_water_marks": {name: mark for name, mark in old_marks.items() if name in {r["table_name"] for r in failed}}
        | {r["table_name"]: r["high"] for r in done if r["high"]},
        "failed_tables": [r["table_name"] for r in failed],
        "copies": [tuple(r[k] for k in ("table_name", "kind", "low", "high", "rows", "total_rows", "checksum", "total_checksum")) for r in done]
        + [(r["table_name"], "missing", None, old_marks[r["table_name"]], 0, earlier[r["table_name"]].total_rows, None, earlier[r["table_name"]].total_checksum)
           for r in failed if r["table_name"] in old_marks and r["table_name"] in earlier],
    })
    if options.retention_days > 0:
        removed = apply_simple_retention(spark, destination, options.retention_days, start).count()
        log.add(f"removed {removed} backups older than {options.retention_days} days")
    if options.backup_type == "lakehouse":
        log.write(spark, f"{destination}/_logs", "append", options.fmt)
    else:
        log.write(spark, f"{path}/_logs", "overwrite", options.fmt)

    status = "success" if not failed else "partial_success" if done else "failed"
    if passed is False:
        status = "failed" if status == "failed" else "partial_success"
    return RunResult(status, path, [r["table_name"] for r in done], [r["table_name"] for r in failed], [], files_count,
                     size_bytes, (end - start).total_seconds(), passed)


def write_verification(spark: SparkSession, verification: DataFrame, path: str) -> bool:
    """One JSON row per table in ``_verification``; returns the logical AND (true without tables)."""
    verification.write.mode("overwrite").json(f"{path}/_verification")
    written = spark.read.schema(verification.schema).json(f"{path}/_verification")
    return bool(written.agg(F.coalesce(F.bool_and("verified"), F.lit(True))).first()[0])


def apply_simple_retention(spark: SparkSession, destination: str, retention_days: int, as_of: dt.datetime) -> DataFrame:
    """Delete backups older than ``retention_days``; names may lack the id; <= 0 deletes nothing.

    Returns one row per deleted folder with its error. No patterns, no preservation; but a folder
    that a younger increment builds on stays.
    """
    location = destination.rstrip("/")
    catalog = settle(top_folders(list_tree(spark, [location], deep=False)), "folders")
    folders = catalog
    ts = folder_timestamp(F.col("folder_name"), lenient=True)
    catalog = catalog.withColumn("age_days", age_days(ts, as_of_column(as_of))).where(F.col("age_days").isNotNull())
    plan = simple_retention(catalog, retention_days)
    if plan.where("reason IS NOT NULL").isEmpty():
        return plan.select("location", "folder_name", "path", "age_days", F.lit(None).cast("string").alias("error"),
                           F.lit(False).alias("already_gone")).limit(0)
    plan = without_needed(plan, manifests.all_manifests(spark, [location], folders))
    due = settle(plan.where("reason IS NOT NULL").select("location", "folder_name", "path", "age_days"), "due")
    return delete_paths(due, folders=True, label="deleted", locations=[location])


def sweep(spark: SparkSession, lakehouses: list[dict], options_for, parallel: int = 3) -> list[dict]:
    """Back up many lakehouses, ``parallel`` at a time (1 = one after the other).

    ``lakehouses``: dicts with name, source, workspaceId, tableFilter; ``options_for(lakehouse)``
    gives their BackupOptions. One result per lakehouse, errors included.
    """
    by_name = {lakehouse["name"]: lakehouse for lakehouse in lakehouses}

    def run(name: str) -> dict:
        result = backup(spark, by_name[name]["source"], options_for(by_name[name]))
        return {"lakehouse": name, "status": result.status, "path": result.path, "tables": len(result.tables),
                "failed": len(result.failed), "size_bytes": result.size_bytes}

    return per_table(spark, list(by_name), run, parallel)
