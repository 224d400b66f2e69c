"""Round trips on real folders: back up, verify, damage, restore, discover, clean up."""

import datetime as dt
import glob
import os
import shutil
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keepsake.options import BackupOptions, CleanupOptions, PreserveOptions, RestoreOptions, RetentionOptions
from keepsake.plans import backup as b
from keepsake.plans import cleanup as c
from keepsake.plans import restore as r
from keepsake.plans.discover import discover
from keepsake.sources import manifests, storage
from keepsake.sources.storage import folder_sizes, list_tables, list_tree
from workload import jobs

T0 = dt.datetime(2024, 1, 15, 10, 30, 0)
SMALL = ["region", "nation", "supplier", "embeddings"]


def options(dest, **kw):
    defaults = {"verify": False, "include_logs": False, "retention_days": 0}
    return BackupOptions(source_name="lake", destination=dest, **{**defaults, **kw})


def test_round_trip(spark, sf_dir, folder):
    done = b.backup(spark, sf_dir, options(f"{folder}/b", verify=True, include_logs=True, retention_days=30, content_check=True), at=T0)
    assert done.status == "success" and done.verification_passed is True
    assert sorted(done.tables) == sorted(list_tables(spark, sf_dir)) and len(done.tables) == 14
    manifest = manifests.read_manifest(spark, done.path)
    assert manifest.backup_timestamp == "2024-01-15 10:30:00" and manifest.files_count >= 14
    assert manifest.backup_size_bytes == sum(
        os.path.getsize(f) for t in done.tables for f in glob.glob(f"{done.path}/{t}/*.parquet"))

    back = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert back.status == "success" and back.verification_passed is True and len(back.tables) == 14
    for name in SMALL:
        left, right = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.read.parquet(f"{folder}/r/{name}")
        assert left.schema == right.schema
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    assert [n for n in os.listdir(f"{folder}/r") if n.startswith(".")] == []


def test_restore_skips_or_overwrites(spark, sf_dir, folder):
    done = b.backup(spark, sf_dir, options(f"{folder}/b", table_filter="region,nat*"), at=T0)
    assert sorted(done.tables) == ["nation", "region"]
    spark.range(3).write.parquet(f"{folder}/r/region")
    kept = r.restore(spark, RestoreOptions(done.path, f"{folder}/r", overwrite=False))
    assert kept.skipped == ["region"] and kept.tables == ["nation"] and kept.status == "success"
    assert spark.read.parquet(f"{folder}/r/region").count() == 3
    forced = r.restore(spark, RestoreOptions(done.path, f"{folder}/r", tables=" region, "))
    assert forced.tables == ["region"] and spark.read.parquet(f"{folder}/r/region").count() == 5


def test_damaged_backup_aborts_restore(spark, sf_dir, folder):
    done = b.backup(spark, sf_dir, options(f"{folder}/b", table_filter="region,nation"), at=T0)
    for part in glob.glob(f"{done.path}/region/*.parquet"):
        with open(part, "wb") as f:
            f.write(b"not parquet")
        crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    result = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert result.status == "failed" and result.failed == ["region"] and not os.path.exists(f"{folder}/r/nation")


def test_failed_table_does_not_stop_others(spark, sf_dir, folder):
    os.makedirs(f"{folder}/lake/broken")
    spark.range(5).write.parquet(f"{folder}/lake/good")
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    assert done.status == "partial_success" and done.tables == ["good"] and done.failed == ["broken"]
    assert manifests.read_manifest(spark, done.path).failed_tables == ["broken"]


def test_empty_lakehouse_keeps_its_manifest(spark, folder):
    os.makedirs(f"{folder}/lake")
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    assert done.status == "success" and done.verification_passed is None
    assert manifests.read_manifest(spark, done.path).tables == []


@pytest.mark.parametrize("mode", ["incremental", "differential"])
def test_increments(spark, folder, mode):
    lake, dest = f"{folder}/lake", f"{folder}/b"

    def write(upto):
        spark.range(upto).selectExpr("id", "id * 2 AS v").write.mode("overwrite").parquet(f"{lake}/facts")
        spark.range(upto // 10).write.mode("overwrite").parquet(f"{lake}/dims")

    marks = {"high_water_columns": {"facts": "id"}}
    write(100)
    first = b.backup(spark, lake, options(dest, mode=mode, **marks), at=T0)
    assert manifests.read_manifest(spark, first.path).backup_mode == "full"
    copied = []
    for day, upto in ((1, 150), (2, 230)):
        write(upto)
        last = b.backup(spark, lake, options(dest, mode=mode, **marks), at=T0 + dt.timedelta(days=day))
        copied.append(spark.read.parquet(f"{last.path}/facts").count())
    assert copied == ([50, 80] if mode == "incremental" else [50, 130])
    back = r.restore(spark, RestoreOptions(last.path, f"{folder}/r"))
    assert back.status == "success"
    assert sorted(x.id for x in spark.read.parquet(f"{folder}/r/facts").collect()) == list(range(230))
    assert spark.read.parquet(f"{folder}/r/dims").count() == 23


def make_backup(folder, name, size, manifest=None, spark=None, tables=()):
    os.makedirs(f"{folder}/{name}/t/p=1")
    with open(f"{folder}/{name}/t/p=1/.hidden", "wb") as f:
        f.write(b"x" * size)
    if manifest:
        manifests.write_manifest(spark, f"{folder}/{name}", {"backup_id": name[-3:], "source_lakehouse_name": manifest,
                                                              "tables": list(tables), "backup_type": "adls"})


def test_discover(spark, folder):
    make_backup(folder, "backup_2024-01-15_10-30-00_abc", 100, "lake", spark, ["a", "b"])
    make_backup(folder, "backup_2024-1-5_1-3-0_zz_yy", 7)
    make_backup(folder, "backup_2024-13-15_10-30-00_a", 5)
    make_backup(folder, "manual_2024-01-15_10-30-00_a", 5)
    os.makedirs(f"{folder}/_cleanup_reports")
    os.makedirs(f"{folder}/backup_2024-01-20_00-00-00_empty")
    catalog, rejected = discover(spark, [folder], "2024-01-21 00:00:00")
    rows = {x.folder_name: x for x in catalog.collect()}
    assert sorted(rows) == ["backup_2024-01-15_10-30-00_abc", "backup_2024-01-20_00-00-00_empty", "backup_2024-1-5_1-3-0_zz_yy"]
    one = rows["backup_2024-01-15_10-30-00_abc"]
    assert (one.source_lakehouse, one.tables_count, one.backup_type, one.age_days) == ("lake", 2, "adls", 5)
    assert one.size_bytes >= 100
    other = rows["backup_2024-1-5_1-3-0_zz_yy"]
    assert (other.source_lakehouse, other.tables_count, other.size_bytes, other.backup_id) == ("Unknown", 0, 7, "zz")
    assert rows["backup_2024-01-20_00-00-00_empty"].size_bytes == 0
    assert [x.folder_name for x in rejected.collect()] == ["backup_2024-13-15_10-30-00_a"]
    only, _ = discover(spark, [folder], "2024-01-21 00:00:00", exclude="*_abc")
    assert "backup_2024-01-15_10-30-00_abc" not in {x.folder_name for x in only.collect()}


@pytest.mark.parametrize("budget", [1, 3, 100_000])
def test_listing_counts_every_file(spark, folder, budget, monkeypatch):
    monkeypatch.setattr(storage, "ENTRIES_IN_ONE_TASK", budget)
    total = 0
    for i in range(3):
        for depth in ("a", "a/_log", "a/b/.c"):
            os.makedirs(f"{folder}/f{i}/{depth}", exist_ok=True)
            with open(f"{folder}/f{i}/{depth}/x", "wb") as f:
                f.write(b"x" * (i + 1))
            total += i + 1
    tree = list_tree(spark, [folder])
    folders = [x.path for x in tree.where("is_dir").collect()]
    assert len(folders) == len(set(folders)) == 3 * 5
    sizes = folder_sizes(tree).collect()
    assert sum(x.size_bytes for x in sizes) == total and all(x.files == 3 for x in sizes)


@pytest.mark.parametrize("dry_run", [True, False])
def test_cleanup(spark, folder, dry_run):
    names = [f"backup_2024-01-{day:02d}_10-00-00_{day:08d}" for day in range(1, 21)]
    for name in names:
        make_backup(folder, name, 10)
    make_backup(folder, "manual_2024-01-01_10-00-00_a", 10)
    opts = CleanupOptions(RetentionOptions("advanced", 9, 5, 40, PreserveOptions("daily", 1, 1, 1)), dry_run=dry_run)
    result = c.cleanup(spark, [folder], opts, dt.datetime(2024, 1, 21))
    left = sorted(n for n in os.listdir(folder) if n.startswith("backup_"))
    assert result.status == "success" and os.path.exists(f"{folder}/manual_2024-01-01_10-00-00_a")
    total = result.totals.collect()[0]
    # age: days 1-10 (older than 9 days); count: 5 newest of 11-19; size: 6 x 10 bytes against 40
    assert (total.processed, total.successful, total.failed, total.freed_bytes) == (16, 16, 0, 160)
    assert left == (names if dry_run else names[16:])
    rows = result.results.collect()
    assert all(x.dry_run == dry_run and x.deleted == (not dry_run) and x.would_delete for x in rows)
    reports = os.listdir(f"{folder}/_cleanup_reports")
    assert sorted(reports) == ["cleanup_report_20240121_000000", "deletion_results", "discovered_backups"]
    again = c.cleanup(spark, [folder], opts, dt.datetime(2024, 1, 21))
    assert again.totals.count() == (1 if dry_run else 0)


def test_delete_refuses_foreign_paths(spark, folder):
    os.makedirs(f"{folder}/precious")
    plan = spark.sql(f"""SELECT '{folder}/b' AS location, 'backup_x' AS folder_name, '{folder}/precious' AS full_path,
        1L AS size_bytes, 1L AS age_days, timestamp_ntz '2024-01-01 00:00:00' AS ts, 'age' AS reason""")
    rows = c.execute(plan, dry_run=False).collect()
    assert rows[0].deleted is False and rows[0].error.startswith("refused") and os.path.exists(f"{folder}/precious")


def test_simple_retention_is_lenient(spark, folder):
    for name in ("backup_2024-01-01_00-00-00", "backup_2024-01-01_00-00-00_a", "backup_2024-02-01_00-00-00_b", "other"):
        os.makedirs(f"{folder}/{name}")
    assert b.apply_simple_retention(spark, folder, 0, dt.datetime(2024, 2, 2)).count() == 0
    gone = b.apply_simple_retention(spark, folder, 7, dt.datetime(2024, 2, 2)).collect()
    assert len(gone) == 2 and all(x.error is None for x in gone)
    assert sorted(os.listdir(folder)) == ["backup_2024-02-01_00-00-00_b", "other"]


def test_list_and_compare(spark, sf_dir, folder):
    one = b.backup(spark, sf_dir, options(folder, table_filter="region,nation"), at=T0)
    two = b.backup(spark, sf_dir, options(folder, table_filter="region,supplier"), at=T0 + dt.timedelta(days=1))
    listed = r.list_backups(spark, folder, "2024-02-01 00:00:00").collect()
    assert len(listed) == 2 and all(x.source_lakehouse == "lake" and x.tables_count == 2 and x.error is None for x in listed)
    places = {x.table_name: x.place for x in r.compare_backups(spark, one.path, two.path).collect()}
    assert places == {"region": "common", "nation": "only_in_first", "supplier": "only_in_second"}


def test_sweep(spark, sf_dir, folder):
    lakes = [{"name": "a", "source": sf_dir, "tableFilter": "region"}, {"name": "b", "source": sf_dir, "tableFilter": "nation"},
             {"name": "c", "source": f"{folder}/none", "tableFilter": "*"}]
    out = b.sweep(spark, lakes, lambda x: BackupOptions(x["name"], f"{folder}/{x['name']}", table_filter=x["tableFilter"]))
    assert [(x["table_name"], x.get("tables")) for x in out] == [("a", 1), ("b", 1), ("c", 0)]


def test_options_are_checked():
    for bad in (dict(mode="age_based", retention_days=0), dict(mode="count_based", max_count=0),
                dict(mode="advanced", max_size_bytes=0), dict(mode="other")):
        with pytest.raises(ValueError):
            RetentionOptions(**bad)
    with pytest.raises(ValueError):
        RestoreOptions("/a/", "/a")
    assert PreserveOptions.from_text("daily", "x", "2", "3") == (PreserveOptions("daily"), [
        "preservation counts reset to (7, 4, 12): invalid literal for int() with base 10: 'x'"])
    assert PreserveOptions.from_text("daily", "1", "2", "3") == (PreserveOptions("daily", 1, 2, 3), [])


def test_partitioned_tables_keep_their_layout(spark, folder):
    spark.range(40).selectExpr("id", "id % 3 AS p", "concat('x', id % 2) AS q").write.partitionBy("p", "q").parquet(f"{folder}/lake/t")
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    back = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert done.status == back.status == "success"
    assert sorted(x for x in os.listdir(f"{folder}/r/t") if "=" in x) == ["p=0", "p=1", "p=2"]
    left, right = spark.read.parquet(f"{folder}/lake/t"), spark.read.parquet(f"{folder}/r/t")
    assert left.schema == right.schema and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_partition_filter_and_lakehouse_log(spark, folder):
    spark.range(40).selectExpr("id", "id % 3 AS p").write.partitionBy("p").parquet(f"{folder}/lake/t")
    spark.range(5).write.parquet(f"{folder}/lake/u")
    for day in (0, 1):
        done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", partition_filter="p = 1", backup_type="lakehouse", partition_filter_tables=("t",)),
                        at=T0 + dt.timedelta(days=day))
    assert spark.read.parquet(f"{done.path}/t").count() == 13 and spark.read.parquet(f"{done.path}/u").count() == 5
    logs = spark.read.parquet(f"{folder}/b/_logs")
    assert logs.where("message LIKE 'backing up%'").count() == 2 and logs.where("level = 'WARNING'").isEmpty()
    # A table the filter does not apply to fails; it is not copied whole.
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/c", partition_filter="p = 1"), at=T0)
    assert done.tables == ["t"] and done.failed == ["u"] and done.status == "partial_success"


def test_retention_keeps_what_increments_need(spark, folder):
    spark.range(10).write.parquet(f"{folder}/lake/t")
    marks = {"high_water_columns": {"t": "id"}, "mode": "incremental", "retention_days": 7}
    full = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", **marks), at=T0)
    alone = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", retention_days=0), at=T0 - dt.timedelta(days=1))
    b.backup(spark, f"{folder}/lake", options(f"{folder}/b", **marks), at=T0 + dt.timedelta(days=6))
    last = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", **marks), at=T0 + dt.timedelta(days=10))
    assert os.path.exists(full.path) and not os.path.exists(alone.path)
    assert r.restore(spark, RestoreOptions(last.path, f"{folder}/r")).status == "success"
    assert spark.read.parquet(f"{folder}/r/t").count() == 10


def test_sampled_restore_test(spark, folder):
    spark.range(10).write.parquet(f"{folder}/lake/t")
    for day in range(3):
        b.backup(spark, f"{folder}/lake", options(f"{folder}/b", retention_days=0), at=T0 + dt.timedelta(days=day))
    catalog, _ = discover(spark, [f"{folder}/b"], "2024-02-01 00:00:00")
    rows = r.sampled_restore_test(spark, catalog, 100, "s").collect()
    assert len(rows) == 3 and all(x.valid and x.tables == 1 and x.rows == 10 for x in rows)


def test_sampled_restore_test_of_chains(spark, folder):
    def jobs(group, catalog):
        spark.sparkContext.setJobGroup(group, group)
        found = {x.full_path: x for x in r.sampled_restore_test(spark, catalog, 100, "s").collect()}
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    made = []
    for day in range(4):
        spark.range(10 * day, 10 * day + 10).write.mode("append").parquet(f"{folder}/lake/t")
        if not day:
            spark.range(3).write.parquet(f"{folder}/lake/u")
        mode = "incremental" if day else "full"
        made.append(b.backup(spark, f"{folder}/lake", options(f"{folder}/b", retention_days=0, mode=mode, high_water_columns={"t": "id"}),
                             at=T0 + dt.timedelta(days=day)).path)
    plain = f"{folder}/b/{os.path.basename(made[0])[:-8]}ffffffff"
    spark.range(5).write.mode("overwrite").parquet(f"{plain}/t")
    catalog, _ = discover(spark, [f"{folder}/b"], "2024-02-01 00:00:00")
    found, many = jobs("all", catalog)
    assert [(found[p].valid, found[p].tables, found[p].rows) for p in made] == [(True, 2, 13 + 10 * day) for day in range(4)]
    assert (found[plain].valid, found[plain].tables, found[plain].rows) == (True, 1, 5)
    assert many <= jobs("one", catalog.where(F.col("full_path") == plain))[1] + 12

    file = next(f for f in os.listdir(f"{made[1]}/t") if f.endswith(".parquet"))
    with open(f"{made[1]}/t/{file}", "r+b") as out:
        out.write(b"\0" * 40)
    shutil.rmtree(f"{made[2]}/t")
    found, _ = jobs("broken", discover(spark, [f"{folder}/b"], "2024-02-01 00:00:00")[0])
    assert [found[p].valid for p in made] == [True, False, False, False] and file in found[made[1]].error
    shutil.rmtree(made[1])
    found, _ = jobs("missing", discover(spark, [f"{folder}/b"], "2024-02-01 00:00:00")[0])
    assert found[made[0]].valid and found[plain].valid and "missing backup" in found[made[3]].error


def test_tables_of_the_session_catalog(spark, folder):
    spark.range(7).createOrReplaceTempView("zz_registered")
    done = b.backup(spark, f"{folder}/Tables", options(f"{folder}/b", verify=True, table_filter="zz_*"), at=T0)
    assert done.tables == ["zz_registered"] and done.verification_passed is True
    assert spark.read.parquet(f"{done.path}/zz_registered").count() == 7
    spark.catalog.dropTempView("zz_registered")


def test_restore_test_reads_large_row_groups_in_little_memory(folder):
    """One row group far larger than what may be held at once: the reader's memory does not grow with it."""
    used = []
    for n in (200_000, 2_000_000):
        values = np.random.default_rng(n).random(n)
        pq.write_table(pa.table({"a": values, "b": values[::-1]}), f"{folder}/{n}.parquet", row_group_size=n, use_dictionary=False)
        read = f"""import pandas as pd
import pyarrow as pa
from keepsake.plans.restore import _read_files
read = next(_read_files({{"x": "file:"}})(iter([pd.DataFrame({{"location": ["x"], "path": ["{folder}/{n}.parquet"]}})])))
assert read["rows"].tolist() == [{n}] and read["error"].isna().all()
print(pa.default_memory_pool().max_memory())"""
        # A process of its own: the pool's peak is that of the whole process.
        done = subprocess.run([sys.executable, "-c", read], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True)
        used.append(int(done.stdout))
    assert used[1] < 1.5 * used[0] and used[1] < 8_000_000, used


def test_tables_in_folders_named_parquet(spark, folder):
    """A table's folder may end in .parquet, and names may hold characters that an identifier may not."""
    lake = {"a.parquet": 3, "b": 4, "b.parquet": 5, "c-d": 6, "Early.Late.parquet": 7}
    for name, n in lake.items():
        spark.range(n).write.parquet(f"{folder}/lake/{name}")
    named = {"a": 3, "b": 4, "b.parquet": 5, "c-d": 6, "Early.Late": 7}
    spark.range(9).createOrReplaceTempView("keepsake_of_another_folder")
    for query in (jobs.table_inventory, jobs.catalog_inventory):
        assert {x.table_name: x.rows for x in query(spark, f"{folder}/lake").collect()} == named, query
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", verify=True, table_filter="a,c-d"), at=T0)
    assert sorted(done.tables) == ["a", "c-d"] and done.verification_passed is True
    # A copy without manifest is found where it lies.
    back = r.restore(spark, RestoreOptions(f"{folder}/lake", f"{folder}/r"))
    assert sorted(back.tables) == sorted(named)
    assert {name: spark.read.parquet(f"{folder}/r/{name}").count() for name in named} == named
    # The session catalog as a source.
    again = b.backup(spark, f"{folder}/Tables", options(f"{folder}/c", verify=True, table_filter="keepsake_c-d"), at=T0)
    assert again.tables == ["keepsake_c-d"] and again.verification_passed is True
    for name in [*named, "of_another_folder"]:
        spark.catalog.dropTempView(f"`keepsake_{name}`")


def test_cleanup_of_nothing(spark, folder):
    result = c.cleanup(spark, [folder], CleanupOptions(dry_run=False), dt.datetime(2024, 1, 21))
    assert result.status == "warning" and result.results.count() == 0
    with pytest.raises(ValueError):
        c.cleanup(spark, [f"{folder}/missing"], CleanupOptions())


def test_failed_swap_keeps_the_old_table(spark, folder, monkeypatch):
    spark.range(5).write.parquet(f"{folder}/lake/t")
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    spark.range(3).write.parquet(f"{folder}/r/t")
    move = storage.DriverFiles.move

    def failing(self, source, target):
        if target == f"{folder}/r/t" and ".old-" not in source:
            raise OSError("no space")
        move(self, source, target)

    monkeypatch.setattr(storage.DriverFiles, "move", failing)
    result = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert result.status == "failed" and result.failed == ["t"]
    assert spark.read.parquet(f"{folder}/r/t").count() == 3


def facts(spark, lake, upto, broken=False):
    """A table that grows; a broken one cannot be read."""
    if broken:
        os.rename(f"{lake}/facts", f"{lake}/.facts")
        os.makedirs(f"{lake}/facts")
        return
    if os.path.exists(f"{lake}/.facts"):
        os.rmdir(f"{lake}/facts")
        os.rename(f"{lake}/.facts", f"{lake}/facts")
    spark.range(upto).selectExpr("id", "id * 2 AS v").write.mode("overwrite").parquet(f"{lake}/facts")


MARKS = {"high_water_columns": {"facts": "id"}, "verify": True, "content_check": True}


def restored_ids(spark, folder, path):
    back = r.restore(spark, RestoreOptions(path, f"{folder}/r"))
    assert back.status == "success" and back.verification_passed is True
    return sorted(x.id for x in spark.read.parquet(f"{folder}/r/facts").collect())


@pytest.mark.parametrize("mode", ["incremental", "differential"])
def test_a_parent_without_marks_gives_a_whole_copy(spark, folder, mode):
    facts(spark, f"{folder}/lake", 100)
    b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    for day in (1, 2):
        facts(spark, f"{folder}/lake", 100 + 30 * day)
        last = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", mode=mode, **MARKS), at=T0 + dt.timedelta(days=day))
        assert last.verification_passed is True
    assert restored_ids(spark, folder, last.path) == list(range(160))


@pytest.mark.parametrize("mode", ["incremental", "differential"])
def test_a_table_that_failed_once_is_whole_again(spark, folder, mode):
    lake, dest = f"{folder}/lake", f"{folder}/b"
    spark.range(3).write.parquet(f"{lake}/other")
    facts(spark, lake, 100)
    b.backup(spark, lake, options(dest, mode=mode, **MARKS), at=T0)
    facts(spark, lake, 0, broken=True)
    done = b.backup(spark, lake, options(dest, mode=mode, **MARKS), at=T0 + dt.timedelta(days=1))
    assert done.failed == ["facts"] and done.status == "partial_success"
    facts(spark, lake, 130)
    last = b.backup(spark, lake, options(dest, mode=mode, **MARKS), at=T0 + dt.timedelta(days=2))
    copy = manifests.copies_of(manifests.read_manifest(spark, last.path))["facts"]
    assert (copy.kind, copy.rows, copy.total_rows) == ("partial", 30, 130)
    assert restored_ids(spark, folder, last.path) == list(range(130))


def test_rows_without_a_mark_are_copied(spark, folder):
    for day, upto in ((0, 10), (1, 20)):
        spark.range(upto).selectExpr("IF(id % 5 = 0, NULL, id) AS id").write.mode("overwrite").parquet(f"{folder}/lake/facts")
        last = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", mode="incremental", **MARKS), at=T0 + dt.timedelta(days=day))
    r.restore(spark, RestoreOptions(last.path, f"{folder}/r"))
    assert spark.read.parquet(f"{folder}/r/facts").count() == 20


@pytest.mark.parametrize("damage", ["text", "checksum", "gone"])
def test_a_manifest_that_cannot_be_read_aborts(spark, folder, damage):
    for day, upto in ((0, 100), (1, 130)):
        facts(spark, f"{folder}/lake", upto)
        last = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", mode="incremental", **MARKS), at=T0 + dt.timedelta(days=day))
    for part in glob.glob(f"{last.path}/_manifest/*.json"):
        crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
        if damage != "checksum":
            os.remove(crc)
        with open(part, "w") as f:
            f.write("" if damage == "gone" else "{broken")
    with pytest.raises(Exception):
        r.restore(spark, RestoreOptions(last.path, f"{folder}/r"))
    assert not os.path.exists(f"{folder}/r/facts")
    with pytest.raises(Exception):
        c.cleanup(spark, [f"{folder}/b"], CleanupOptions(RetentionOptions("age_based", 1), dry_run=False), dt.datetime(2024, 3, 1))
    assert len(glob.glob(f"{folder}/b/backup_*")) == 2


def test_cleanup_keeps_the_base_of_what_it_does_not_see(spark, folder):
    marks = {**MARKS, "mode": "incremental"}
    facts(spark, f"{folder}/lake", 100)
    full = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", **marks), at=T0)
    facts(spark, f"{folder}/lake", 130)
    kept = b.backup(spark, f"{folder}/lake", options(f"{folder}/b", backup_folder="manual_keep", **marks), at=T0 + dt.timedelta(days=1))
    result = c.cleanup(spark, [f"{folder}/b"], CleanupOptions(RetentionOptions("age_based", 1), dry_run=False), dt.datetime(2024, 3, 1))
    assert result.results.isEmpty() and os.path.exists(full.path)
    assert restored_ids(spark, folder, kept.path) == list(range(130))


def test_two_failed_renames_leave_the_old_table(spark, folder, monkeypatch):
    spark.range(5).write.parquet(f"{folder}/lake/t")
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    spark.range(3).write.parquet(f"{folder}/r/t")
    move = storage.DriverFiles.move

    def failing(self, source, target):
        if target == f"{folder}/r/t":
            raise OSError("no space")
        move(self, source, target)

    monkeypatch.setattr(storage.DriverFiles, "move", failing)
    result = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    old = glob.glob(f"{folder}/r/.old-*-t")
    assert result.status == "failed" and len(old) == 1 and old[0] in result.message
    assert spark.read.parquet(old[0]).count() == 3


def test_deletes_tell_gone_from_deleted(spark, folder):
    os.makedirs(f"{folder}/backup_a")
    rows = spark.createDataFrame([(folder, f"{folder}/backup_a"), (folder, f"{folder}/backup_b")], "location string, path string")
    found = {x.path[-1]: (x.error, x.already_gone) for x in storage.delete_paths(rows, True, "gone", [folder]).collect()}
    assert found == {"a": (None, False), "b": (None, True)} and not os.path.exists(f"{folder}/backup_a")
    with pytest.raises(ValueError):
        storage.qualified(spark, ["viewfs://somewhere/x"])


def test_a_location_that_cannot_be_listed_raises(spark, folder):
    with pytest.raises(OSError):
        list_tree(spark, [f"{folder}/missing"])


def test_integrity_reads_the_pages(spark, folder):
    spark.range(50_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(f"{folder}/lake/t")
    done = b.backup(spark, f"{folder}/lake", options(f"{folder}/b"), at=T0)
    for part in glob.glob(f"{done.path}/t/*.parquet"):
        os.remove(os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc"))
        with open(part, "r+b") as f:
            f.seek(1000)
            f.write(b"\0" * 100_000)
    result = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert result.status == "failed" and result.failed == ["t"]
