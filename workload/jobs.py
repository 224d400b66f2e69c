"""Whole jobs over the test tables: inventory, backup, verification, restore, discovery, cleanup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keepsake.operators.reconcile import portable_checksum
from keepsake.options import BackupOptions, CleanupOptions, RestoreOptions, RetentionOptions
from keepsake.plans import backup as jobs
from keepsake.plans import cleanup as cleaning
from keepsake.plans.discover import discover
from keepsake.plans.restore import compare_backups, list_backups, restore, sampled_restore_test
from keepsake.schemas import TABLE_METADATA
from keepsake.session import fresh_path
from keepsake.sources import manifests, storage
from keepsake.sources.storage import DriverFiles, list_catalog_tables, list_tables, quoted

AT = dt.datetime(2024, 1, 15, 10, 30, 0)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _union(parts):
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _counts(spark, paths):
    return _union([
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, path in sorted(paths.items())])


def table_inventory(spark, sf_dir):
    """Tables found in the folder, with their row counts in one job."""
    return _counts(spark, list_tables(spark, sf_dir))


def catalog_inventory(spark, sf_dir):
    """The same through the session catalog."""
    # The catalog may fold the case of names, and hold views of other folders.
    views = {}
    for name, path in list_tables(spark, sf_dir).items():
        view = f"keepsake_{name}"
        spark.read.parquet(path).createOrReplaceTempView(quoted(view))
        views[view.lower()] = name
    return _union([
        spark.table(quoted(view)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(views[view.lower()]).alias("table_name"), "rows")
        for view in list_catalog_tables(spark) if view.lower() in views])


def _backup(spark, sf_dir, destination, **options):
    return jobs.backup(spark, sf_dir, BackupOptions("test lake", destination, **options), at=AT)


def backup_verified(spark, sf_dir):
    """Back up all tables, then compare row counts and content."""
    done = _backup(spark, sf_dir, fresh_path(spark, "backup"), content_check=True)
    rows = spark.read.schema("table_name string, source_rows bigint, backup_rows bigint, verified boolean").json(f"{done.path}/_verification")
    return rows


def tables_restored(spark, sf_dir):
    """Back up all tables, restore them elsewhere, and count."""
    base = fresh_path(spark, "restore")
    done = _backup(spark, sf_dir, f"{base}/backups", verify=False)
    back = restore(spark, RestoreOptions(done.path, f"{base}/restored"))
    return _counts(spark, {name: f"{base}/restored/{name}" for name in back.tables}).withColumn(
        "verified", F.lit(back.verification_passed))


def restored_content(spark, sf_dir):
    """Restored lineitem rows as read back from the restored table."""
    base = fresh_path(spark, "content")
    done = _backup(spark, sf_dir, f"{base}/backups", verify=False, table_filter="lineitem,nat*")
    restore(spark, RestoreOptions(done.path, f"{base}/restored", tables="lineitem", verify_after=False, validate_before=False))
    rows = spark.read.parquet(f"{base}/restored/lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


_DAYS = {"backup_2024-01-01_10-00-00_00000001": "orders,customer", "backup_2024-01-08_10-00-00_00000002": "lineitem",
         "backup_2024-01-14_10-00-00_00000003": "orders,events,nation", "backup_2024-01-15_10-00-00_00000004": "region"}


def _four_backups(spark, sf_dir):
    location = fresh_path(spark, "location")
    for name, tables in _DAYS.items():
        _backup(spark, sf_dir, location, verify=False, backup_folder=name, table_filter=tables, retention_days=0)
    return location


def backups_discovered(spark, sf_dir):
    location = _four_backups(spark, sf_dir)
    catalog, _ = discover(spark, [location], "2024-01-16 00:00:00")
    rows = catalog.select("folder_name", "ts", "backup_id", "age_days", "source_lakehouse",
                          F.col("tables_count").cast("bigint").alias("tables_count"),
                          (F.col("size_bytes") > F.col("manifest.backup_size_bytes")).alias("counts_hidden_files"))
    return rows


def cleanup_executed(spark, sf_dir):
    """Delete what is older than a week, for real; the deletion results."""
    location = _four_backups(spark, sf_dir)
    options = CleanupOptions(RetentionOptions("age_based", retention_days=6), dry_run=False)
    result = cleaning.cleanup(spark, [location], options, dt.datetime(2024, 1, 16))
    return result.results.select("folder_name", "age_days", "ts", "would_delete", "deleted",
                                 F.col("error").isNotNull().alias("failed"), "dry_run")


def table_checksums(spark, sf_dir):
    """Row count and a checksum of all values per table, one job for all tables."""
    return _union([portable_checksum(spark.read.parquet(path)).select(F.lit(name).alias("table_name"), "rows", "checksum")
                   for name, path in sorted(list_tables(spark, sf_dir).items())])


SPLIT = "1999-06-30 00:00:00"
_MARKS = {"high_water_columns": {"lineitem": "l_shipdate"}, "table_filter": "lineitem,region", "retention_days": 0}


def _growing_lake(spark, sf_dir, base):
    """A lake whose lineitem ends at SPLIT, and a function that appends the rest."""
    lines, lake = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), f"{base}/lake"
    mark = F.lit(SPLIT).cast("timestamp_ntz")
    lines.where(F.col("l_shipdate") <= mark).write.parquet(f"{lake}/lineitem")
    spark.read.parquet(f"{sf_dir}/region.parquet").write.parquet(f"{lake}/region")
    return lake, lambda: lines.where(F.col("l_shipdate") > mark).write.mode("append").parquet(f"{lake}/lineitem")


def _increment(spark, sf_dir, mode, label):
    """Full backup, more rows, and a backup in ``mode`` on top, verified."""
    base = fresh_path(spark, label)
    lake, grow = _growing_lake(spark, sf_dir, base)
    jobs.backup(spark, lake, BackupOptions("test lake", f"{base}/backups", mode=mode, verify=False, **_MARKS), at=AT)
    grow()
    done = jobs.backup(spark, lake, BackupOptions("test lake", f"{base}/backups", mode=mode, content_check=True, **_MARKS), at=AT + dt.timedelta(days=1))
    return base, done


def _restored(mode):
    def query(spark, sf_dir):
        """The table put together again from a full backup and what came after."""
        base, done = _increment(spark, sf_dir, mode, mode)
        back = restore(spark, RestoreOptions(done.path, f"{base}/restored"))
        rows = spark.read.parquet(f"{base}/restored/lineitem")
        return rows.groupBy("l_returnflag", "l_linestatus").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
            F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")).withColumn("verified", F.lit(back.verification_passed))
    return query


def incremental_verified(spark, sf_dir):
    """Verification of an increment: the rows it took, counted and compared by content."""
    _, done = _increment(spark, sf_dir, "incremental", "verified")
    return spark.read.schema("table_name string, source_rows bigint, backup_rows bigint, verified boolean").json(f"{done.path}/_verification")


def incremental_restored_zones(spark, sf_dir):
    """Instants as marks: a full backup and two increments, each run in another time zone, put together again."""
    base = fresh_path(spark, "zones")
    micros = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 86_400_000_000
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("moment", F.timestamp_micros(micros + F.col("l_linenumber").cast("bigint") * 1_800_000_000))
    zone = spark.conf.get("spark.sql.session.timeZone")
    steps = [("UTC", "1996-01-01"), ("America/New_York", "1998-01-01"), ("Asia/Tokyo", "2999-01-01")]
    try:
        before = None
        for day, (name, until) in enumerate(steps):
            spark.conf.set("spark.sql.session.timeZone", name)
            some = lines.where(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
            if before:
                some = some.where(F.col("l_shipdate") >= F.lit(before).cast("timestamp_ntz"))
            some.write.mode("append").parquet(f"{base}/lake/lineitem")
            before = until
            done = jobs.backup(spark, f"{base}/lake", BackupOptions("test lake", f"{base}/backups", mode="incremental", content_check=True, retention_days=0,
                                                                    high_water_columns={"lineitem": "moment"}), at=AT + dt.timedelta(days=day))
        back = restore(spark, RestoreOptions(done.path, f"{base}/restored"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    rows = spark.read.parquet(f"{base}/restored/lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.sum(F.unix_micros("moment").cast("decimal(38,0)") / F.lit(1_800_000_000)).cast("bigint").alias("half_hours")).withColumn(
        "verified", F.lit(done.verification_passed and back.verification_passed))


def increment_with_late_rows(spark, sf_dir):
    """Rows that arrive below the mark are in no increment: verification compares the whole chain with the source and says so."""
    base = fresh_path(spark, "late")
    lines, lake = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), f"{base}/lake"
    mark, late = F.lit(SPLIT).cast("timestamp_ntz"), F.col("l_linenumber") == 2
    lines.where((F.col("l_shipdate") <= mark) & ~late).write.parquet(f"{lake}/lineitem")
    spark.read.parquet(f"{sf_dir}/region.parquet").write.parquet(f"{lake}/region")
    options = {"mode": "incremental", **_MARKS}
    jobs.backup(spark, lake, BackupOptions("test lake", f"{base}/backups", verify=False, **options), at=AT)
    lines.where((F.col("l_shipdate") > mark) | late).write.mode("append").parquet(f"{lake}/lineitem")
    done = jobs.backup(spark, lake, BackupOptions("test lake", f"{base}/backups", **options), at=AT + dt.timedelta(days=1))
    return spark.read.schema("table_name string, source_rows bigint, total_rows bigint, source_total_rows bigint, verified boolean").json(f"{done.path}/_verification")


def partitions_restored(spark, sf_dir):
    """Folder names of a partitioned table after backup, increment and restore, with their rows: 01 stays 01, also beside Q01."""
    base = fresh_path(spark, "layout")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    month = F.date_format("o_orderdate", "MM")
    split = F.lit("1997-01-01").cast("timestamp_ntz")
    options = {"mode": "incremental", "content_check": True, "high_water_columns": {"orders": "o_orderdate"}, "retention_days": 0}
    for day, (some, name) in enumerate([(F.col("o_orderdate") < split, month), (F.col("o_orderdate") >= split, F.concat(F.lit("Q"), month))]):
        orders.where(some).withColumn("m", name).write.mode("append").partitionBy("m").parquet(f"{base}/lake/orders")
        done = jobs.backup(spark, f"{base}/lake", BackupOptions("test lake", f"{base}/backups", **options), at=AT + dt.timedelta(days=day))
    back = restore(spark, RestoreOptions(done.path, f"{base}/restored"))
    rows = spark.read.parquet(f"{base}/restored/orders").select("*", F.regexp_extract("_metadata.file_path", "/(m=[^/]+)/", 1).alias("folder"))
    return rows.groupBy("folder", "m").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").cast("bigint").alias("keys")).withColumn(
        "verified", F.lit(done.verification_passed and back.verification_passed))


def restored_over(spark, sf_dir):
    """A restore over tables that are there already, with other rows and columns; another table of the target stays."""
    base = fresh_path(spark, "over")
    done = _backup(spark, sf_dir, f"{base}/backups", verify=False, table_filter="orders,customer", retention_days=0)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.parquet(f"{base}/restored/orders")
    spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0").write.parquet(f"{base}/restored/customer")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").write.parquet(f"{base}/restored/supplier")
    back = restore(spark, RestoreOptions(done.path, f"{base}/restored"))
    found = {name: f"{base}/restored/{name}" for name in list_tables(spark, f"{base}/restored")}
    sums = _union([portable_checksum(spark.read.parquet(path)).select(F.lit(name).alias("table_name"), "rows", "checksum") for name, path in sorted(found.items())])
    return sums.withColumn("restored", F.col("table_name").isin(back.tables))


def restored_without_manifest(spark, sf_dir):
    """A folder of tables that nobody wrote a manifest for: its visible folders are what is restored."""
    base = fresh_path(spark, "plain")
    for name in ("orders", "nation", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{base}/copy/{name}")
    spark.range(1).write.parquet(f"{base}/copy/_hidden")
    back = restore(spark, RestoreOptions(f"{base}/copy", f"{base}/restored"))
    sums = _union([portable_checksum(spark.read.parquet(f"{base}/restored/{name}")).select(F.lit(name).alias("table_name"), "rows", "checksum") for name in sorted(back.tables)])
    return sums.withColumn("verified", F.lit(back.verification_passed))


def flushed_log_read_back(spark, sf_dir):
    """The log of one run in its own backup folder: a later run does not add to it. Tables it names, with their rows."""
    location = fresh_path(spark, "flushed")
    done = [jobs.backup(spark, sf_dir, BackupOptions("test lake", location, verify=False, table_filter=tables, retention_days=0), at=AT + dt.timedelta(days=day))
            for day, tables in enumerate(("nation,region,orders", "supplier"))]
    log = spark.read.parquet(f"{done[0].path}/_logs").where("message LIKE '%: copied'").select(F.regexp_replace("message", ": copied$", "").alias("table_name"), "level")
    return log.join(_counts(spark, list_tables(spark, done[0].path)), "table_name")


def _left_in(spark, location):
    """Rows of every table of every backup folder of a location, as read back."""
    found = []
    for name, is_folder in DriverFiles(spark).entries(location):
        if is_folder and name.startswith("backup_"):
            found += [_counts(spark, {table: path}).select(F.lit(name).alias("folder_name"), "table_name", "rows")
                      for table, path in sorted(list_tables(spark, f"{location}/{name}").items())]
    return _union(found)


def simple_retention_executed(spark, sf_dir):
    """What is left after backups older than six days went, by the simple rule."""
    location = _four_backups(spark, sf_dir)
    jobs.apply_simple_retention(spark, location, 6, dt.datetime(2024, 1, 16))
    return _left_in(spark, location)


def cleanup_survivors(spark, sf_dir):
    """What is left after a cleanup that keeps the two newest backups."""
    location = _four_backups(spark, sf_dir)
    cleaning.cleanup(spark, [location], CleanupOptions(RetentionOptions("count_based", max_count=2), dry_run=False), dt.datetime(2024, 1, 16))
    return _left_in(spark, location)


def reports_read_back(spark, sf_dir):
    """Inventory and deletion results as cleanup wrote them, with the tables each folder had when it was backed up."""
    location = _four_backups(spark, sf_dir)
    cleaning.cleanup(spark, [location], CleanupOptions(RetentionOptions("age_based", retention_days=6), dry_run=False), dt.datetime(2024, 1, 16))
    base = f"{location}/_cleanup_reports"
    listed = spark.read.parquet(f"{base}/discovered_backups").select("folder_name", "tables_count", "status")
    gone = spark.read.parquet(f"{base}/deletion_results").select("folder_name", "deleted")
    total = spark.read.json(f"{base}/cleanup_report_*").first()
    rows = listed.join(gone, "folder_name", "left")
    return rows.select("folder_name", F.col("tables_count").cast("bigint").alias("tables_count"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
                       F.lit(total.total_backups_discovered).cast("bigint").alias("discovered"), F.lit(total.total_backups_deleted).cast("bigint").alias("deleted_in_report"))


def logs_read_back(spark, sf_dir):
    """What the appended log of two runs says of each table."""
    location = fresh_path(spark, "logs")
    for day in (0, 1):
        jobs.backup(spark, sf_dir, BackupOptions("test lake", location, verify=False, backup_type="lakehouse", table_filter="nation,region,orders", retention_days=0),
                    at=AT + dt.timedelta(days=day))
    log = spark.read.parquet(f"{location}/_logs").where("message LIKE '%: copied'")
    return log.groupBy(F.regexp_replace("message", ": copied$", "").alias("table_name"), "level").agg(F.count(F.lit(1)).alias("n"))


def metadata_read_back(spark, sf_dir):
    """Tables and their number of columns, as the restored table metadata says."""
    base = fresh_path(spark, "metadata")
    done = _backup(spark, sf_dir, f"{base}/backups", verify=False, table_filter="orders,customer,embeddings", retention_days=0)
    restore(spark, RestoreOptions(done.path, f"{base}/restored", verify_after=False, validate_before=False))
    rows = spark.read.schema(TABLE_METADATA).json(f"{base}/restored/_table_metadata")
    return rows.select("table_name", F.size(F.from_json(F.get_json_object("schema_json", "$.fields"), "array<string>")).cast("bigint").alias("columns"), "format")


def table_statistics(spark, sf_dir):
    """Tables found by listing their files, with the rows those files hold."""
    found = storage.table_statistics(spark, list_tables(spark, sf_dir), "parquet").where("num_files > 0 AND size_bytes > 0")
    return found.select("table_name").join(_counts(spark, list_tables(spark, sf_dir)), "table_name")


def restore_skips(spark, sf_dir):
    """Restore without overwriting: nation is there already and stays as it is."""
    base = fresh_path(spark, "skips")
    done = _backup(spark, sf_dir, f"{base}/backups", verify=False, table_filter="nation,region,supplier", retention_days=0)
    spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1").write.parquet(f"{base}/restored/nation")
    back = restore(spark, RestoreOptions(done.path, f"{base}/restored", overwrite=False))
    counts = _counts(spark, {name: f"{base}/restored/{name}" for name in [*back.tables, *back.skipped]})
    return counts.withColumn("skipped", F.col("table_name").isin(back.skipped))


def backups_listed(spark, sf_dir):
    """Backups with what their manifests say, and the rows they promise."""
    location = _four_backups(spark, sf_dir)
    listed = list_backups(spark, location, "2024-01-16 00:00:00").select("folder_name", "source_lakehouse", F.col("tables_count").cast("bigint").alias("tables_count"))
    rows = manifests.read_manifests(spark, [location]).select("folder_name", F.aggregate("manifest.copies", F.lit(0).cast("bigint"), lambda n, c: n + c["rows"]).alias("rows"))
    return listed.join(rows, "folder_name")


def backups_compared(spark, sf_dir):
    """Tables of two backups by place, with the rows of the copy."""
    location = _four_backups(spark, sf_dir)
    one, two = (f"{location}/{name}" for name in list(_DAYS)[0:3:2])
    places = compare_backups(spark, one, two)
    both = _union([_counts(spark, list_tables(spark, one)), _counts(spark, list_tables(spark, two))]).distinct()
    return places.join(both, "table_name")


def lakehouses_swept(spark, sf_dir):
    """Two lakehouses backed up in one sweep, and the rows that arrived."""
    base = fresh_path(spark, "sweep")
    lakes = [{"name": "a", "source": sf_dir, "tableFilter": "orders"}, {"name": "b", "source": sf_dir, "tableFilter": "region,nation"}]
    done = jobs.sweep(spark, lakes, lambda x: BackupOptions(x["name"], f"{base}/{x['name']}", table_filter=x["tableFilter"], retention_days=0))
    return _union([_counts(spark, list_tables(spark, r["path"])).withColumn("lakehouse", F.lit(r["lakehouse"])).withColumn("status", F.lit(r["status"])) for r in done])


def restore_tested(spark, sf_dir):
    """Restore test of every backup: it loads, and holds so many rows."""
    catalog, _ = discover(spark, [_four_backups(spark, sf_dir)], "2024-01-16 00:00:00")
    rows = sampled_restore_test(spark, catalog, 100, "seed")
    return rows.select(F.element_at(F.split("full_path", "/"), -1).alias("folder_name"), "valid", "tables", "rows")


QUERIES = {
    "table_inventory": table_inventory,
    "catalog_inventory": catalog_inventory,
    "table_checksums": table_checksums,
    "backup_verified": backup_verified,
    "tables_restored": tables_restored,
    "restored_content": restored_content,
    "backups_discovered": backups_discovered,
    "cleanup_executed": cleanup_executed,
    "incremental_restored": _restored("incremental"),
    "differential_restored": _restored("differential"),
    "incremental_verified": incremental_verified,
    "simple_retention_executed": simple_retention_executed,
    "cleanup_survivors": cleanup_survivors,
    "reports_read_back": reports_read_back,
    "logs_read_back": logs_read_back,
    "metadata_read_back": metadata_read_back,
    "table_statistics": table_statistics,
    "restore_skips": restore_skips,
    "backups_listed": backups_listed,
    "backups_compared": backups_compared,
    "lakehouses_swept": lakehouses_swept,
    "restore_tested": restore_tested,
    "incremental_restored_zones": incremental_restored_zones,
    "increment_with_late_rows": increment_with_late_rows,
    "partitions_restored": partitions_restored,
    "restored_over": restored_over,
    "restored_without_manifest": restored_without_manifest,
    "flushed_log_read_back": flushed_log_read_back,
}


def _per_table(columns):
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS table_name, {columns} FROM {name}" for name in TABLES)


_BACKUPS = """(VALUES ('backup_2024-01-01_10-00-00_00000001', TIMESTAMP '2024-01-01 10:00:00', 14::BIGINT, 2::BIGINT),
  ('backup_2024-01-08_10-00-00_00000002', TIMESTAMP '2024-01-08 10:00:00', 7, 1),
  ('backup_2024-01-14_10-00-00_00000003', TIMESTAMP '2024-01-14 10:00:00', 1, 3),
  ('backup_2024-01-15_10-00-00_00000004', TIMESTAMP '2024-01-15 10:00:00', 0, 1)) b(folder_name, ts, age_days, tables_count)"""

# Columns by the way their values become text; see portable_checksum.
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal:f c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:f", "part": "p_partkey p_name p_brand p_type p_size p_retailprice:f",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:f o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag l_linestatus l_shipdate:t",
    "events": "event_id ts:t user_id event_type value:f props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:a label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}


def _text_sql(name, kind=""):
    value = {"": name, "f": f"CAST(floor({name}::DOUBLE * 1000000) AS BIGINT)", "t": f"epoch_us({name})",
             "a": f"array_to_string(list_transform({name}, lambda x: coalesce(CAST(floor(x::DOUBLE * 1000000) AS BIGINT)::VARCHAR, '~')), ',')"}[kind]
    return f"coalesce({value}::VARCHAR, '~')"


def _checksum_sql(table):
    row = ", ".join(_text_sql(*column.split(":")) for column in _COLUMNS[table].split())
    return f"""SELECT '{table}' AS table_name, count(*) AS rows,
  CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {row})), 1, 8) AS BIGINT)), 0) AS BIGINT) AS checksum FROM {table}"""


def _held(folder):
    return "\nUNION ALL\n".join(f"SELECT '{folder}' AS folder_name, '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _DAYS[folder].split(","))


_FOLDERS = list(_DAYS)
_LINES = """SELECT l_returnflag, l_linestatus, count(*) AS rows,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship"""

ORACLES = {
    "backups_discovered": f"""SELECT folder_name, ts, folder_name[-8:] AS backup_id, age_days, 'test lake' AS source_lakehouse,
  tables_count, true AS counts_hidden_files FROM {_BACKUPS}""",
    "cleanup_executed": f"""SELECT folder_name, age_days, ts, true AS would_delete, true AS deleted, false AS failed,
  false AS dry_run FROM {_BACKUPS} WHERE age_days > 6""",
    "table_inventory": _per_table("count(*) AS rows"),
    "catalog_inventory": _per_table("count(*) AS rows"),
    "backup_verified": _per_table("count(*) AS source_rows, count(*) AS backup_rows, true AS verified"),
    "tables_restored": _per_table("count(*) AS rows, true AS verified"),
    "restored_content": """SELECT l_returnflag, l_linestatus, count(*) AS rows,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY ALL""",
    "table_checksums": "\nUNION ALL\n".join(map(_checksum_sql, TABLES)),
    "incremental_restored": f"{_LINES}, true AS verified FROM lineitem GROUP BY ALL",
    "differential_restored": f"{_LINES}, true AS verified FROM lineitem GROUP BY ALL",
    "incremental_verified": f"""SELECT 'lineitem' AS table_name, count(*) AS source_rows, count(*) AS backup_rows, true AS verified
FROM lineitem WHERE l_shipdate > TIMESTAMP '{SPLIT}' UNION ALL SELECT 'region', count(*), count(*), true FROM region""",
    "simple_retention_executed": "\nUNION ALL\n".join(map(_held, _FOLDERS[2:])),
    "cleanup_survivors": "\nUNION ALL\n".join(map(_held, _FOLDERS[2:])),
    "reports_read_back": f"SELECT folder_name, count(*) AS tables_count, folder_name < '{_FOLDERS[2]}' AS deleted, 4::BIGINT AS discovered, 2::BIGINT AS deleted_in_report FROM ("
    + " UNION ALL ".join(map(_held, _FOLDERS)) + ") WHERE rows >= 0 GROUP BY folder_name",
    "logs_read_back": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, 'INFO' AS level, 2 * count(DISTINCT 1) AS n FROM {t}" for t in ("nation", "region", "orders")),
    "metadata_read_back": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, 'parquet' AS format"
                                               for t in ("orders", "customer", "embeddings")),
    "table_statistics": _per_table("count(*) AS rows"),
    "restore_skips": """SELECT 'nation' AS table_name, count(*) AS rows, true AS skipped FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'region', count(*), false FROM region UNION ALL SELECT 'supplier', count(*), false FROM supplier""",
    "backups_listed": "SELECT folder_name, 'test lake' AS source_lakehouse, count(*) AS tables_count, CAST(sum(rows) AS BIGINT) AS rows FROM ("
    + " UNION ALL ".join(map(_held, _FOLDERS)) + ") GROUP BY folder_name",
    "backups_compared": """SELECT 'orders' AS table_name, 'common' AS place, count(*) AS rows FROM orders UNION ALL SELECT 'customer', 'only_in_first', count(*) FROM customer
UNION ALL SELECT 'events', 'only_in_second', count(*) FROM events UNION ALL SELECT 'nation', 'only_in_second', count(*) FROM nation""",
    "lakehouses_swept": """SELECT 'orders' AS table_name, count(*) AS rows, 'a' AS lakehouse, 'success' AS status FROM orders
UNION ALL SELECT 'region', count(*), 'b', 'success' FROM region UNION ALL SELECT 'nation', count(*), 'b', 'success' FROM nation""",
    "restore_tested": "SELECT folder_name, true AS valid, count(*) AS tables, CAST(sum(rows) AS BIGINT) AS rows FROM ("
    + " UNION ALL ".join(map(_held, _FOLDERS)) + ") GROUP BY folder_name",
    "incremental_restored_zones": """SELECT l_returnflag, l_linestatus, count(*) AS rows, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(epoch_us(date_trunc('day', l_shipdate)) // 1800000000 + l_linenumber) AS BIGINT) AS half_hours, true AS verified FROM lineitem GROUP BY ALL""",
    "increment_with_late_rows": f"""SELECT 'lineitem' AS table_name, count(*) FILTER (l_shipdate > TIMESTAMP '{SPLIT}') AS source_rows,
  count(*) FILTER (l_shipdate > TIMESTAMP '{SPLIT}' OR l_linenumber <> 2) AS total_rows, count(*) AS source_total_rows, false AS verified FROM lineitem
UNION ALL SELECT 'region', count(*), NULL, NULL, true FROM region""",
    "partitions_restored": """WITH named AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN '' ELSE 'Q' END || strftime(o_orderdate, '%m') AS m, o_orderkey FROM orders)
SELECT 'm=' || m AS folder, m, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS verified FROM named GROUP BY m""",
    "restored_over": "\nUNION ALL\n".join(f"SELECT *, {str(t != 'supplier').lower()} AS restored FROM ({_checksum_sql(t)})" for t in ("orders", "customer", "supplier")),
    "restored_without_manifest": "\nUNION ALL\n".join(f"SELECT *, true AS verified FROM ({_checksum_sql(t)})" for t in ("orders", "nation", "events")),
    "flushed_log_read_back": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, 'INFO' AS level, count(*) AS rows FROM {t}" for t in ("nation", "region", "orders")),
}
