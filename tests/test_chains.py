"""Marks, chains and partition layouts: what is restored is what was there, or verification says no."""

import datetime as dt
import decimal
import os

import pytest
from pyspark.sql import functions as F

from keepsake.functions.marks import mark_fits, mark_text, mark_value
from keepsake.options import BackupOptions, RestoreOptions
from keepsake.plans import backup as b
from keepsake.plans import restore as r
from keepsake.sources import manifests

T0 = dt.datetime(2024, 1, 15, 10, 30, 0)
ZONE = "spark.sql.session.timeZone"


def run(spark, folder, day, column, mode="incremental", **kw):
    marks = {"high_water_columns": {"facts": column}} if column else {}
    options = BackupOptions("lake", f"{folder}/b", **{"mode": mode, "content_check": True, "retention_days": 0, "include_logs": False, **marks, **kw})
    return b.backup(spark, f"{folder}/lake", options, at=T0 + dt.timedelta(days=day))


def restored(spark, folder, done):
    back = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert back.status == "success", back.message
    return back.verification_passed, spark.read.parquet(f"{folder}/r/facts")


def verification(spark, done):
    schema = "table_name string, verified boolean, error string, total_rows bigint, source_total_rows bigint"
    return {x.table_name: x for x in spark.read.schema(schema).json(f"{done.path}/_verification").collect()}


@pytest.fixture
def zone(spark):
    before = spark.conf.get(ZONE)
    yield lambda name: spark.conf.set(ZONE, name)
    spark.conf.set(ZONE, before)


VALUES = {
    "timestamp": ("timestamp_micros(1700000000000000 + id * 1000001)", "timestamp"),
    "ntz": ("CAST('2023-11-05 00:30:00' AS timestamp_ntz) + make_dt_interval(0, 0, id, 0.000001)", "timestamp_ntz"),
    "date": ("date_add(DATE'2023-01-01', CAST(id AS int))", "date"),
    "decimal": ("CAST(id AS decimal(30,10)) / 7", "decimal"),
    "text": ("lpad(CAST(id AS string), 5, '0') || '='", "string"),
    "double": ("id / 7.0D", "double"),
    "binary": ("encode(lpad(CAST(id AS string), 5, '0'), 'UTF-8')", "binary"),
    "short": ("CAST(id AS smallint)", "smallint"),
}


@pytest.mark.parametrize("mode", ["incremental", "differential"])
def test_marks_of_every_type(spark, folder, zone, mode):
    """A table for each type, three runs in three zones: every row once."""
    for day, (upto, where) in enumerate([(20, "UTC"), (27, "America/New_York"), (40, "Asia/Tokyo")]):
        zone(where)
        for name, (text, _) in VALUES.items():
            spark.range(upto).selectExpr("id", f"{text} AS m").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lake/{name}")
        done = run(spark, folder, day, None, mode, high_water_columns={name: "m" for name in VALUES}, verify=day == 2, parallel_tables=8)
    assert done.verification_passed is True and sorted(done.tables) == sorted(VALUES)
    copies = manifests.copies_of(manifests.read_manifest(spark, done.path))
    assert {name: (c.kind, c.total_rows) for name, c in copies.items()} == {name: ("partial", 40) for name in VALUES}
    assert all(copies[name].high.startswith(kind) for name, (_, kind) in VALUES.items())
    back = r.restore(spark, RestoreOptions(done.path, f"{folder}/r", parallel_tables=8))
    assert back.status == "success" and back.verification_passed is True
    for name in VALUES:
        assert sorted(x.id for x in spark.read.parquet(f"{folder}/r/{name}").collect()) == list(range(40)), name


def test_an_hour_that_comes_twice(spark, folder, zone):
    """Instants of both halves of the repeated hour, in the zone that repeats it."""
    zone("America/New_York")
    start = 1699160400 - 3600
    for day, upto in ((0, 12), (1, 20)):
        spark.range(upto).selectExpr("id", f"timestamp_seconds({start} + id * 900) AS m").write.mode("overwrite").parquet(f"{folder}/lake/facts")
        done = run(spark, folder, day, "m")
        passed, rows = restored(spark, folder, done)
        assert passed and rows.count() == upto


def test_marks_read_back(spark):
    for text, kind in VALUES.values():
        df = spark.range(5).selectExpr(f"{text} AS m")
        mark = df.agg(mark_text(F.max("m"), df.schema["m"].dataType).alias("t")).first().t
        assert mark_fits(mark, df.schema["m"].dataType) and mark.startswith(kind)
        assert df.where(F.col("m") >= mark_value(mark)).count() == 1
    assert spark.range(1).select(mark_value("decimal(30,10)=-0.0000000001").alias("x")).first().x == decimal.Decimal("-0.0000000001")
    types = spark.range(1).selectExpr("id", "CAST(id AS int) AS i", "timestamp_micros(id) AS t", "array(id) AS a").schema
    assert mark_fits("int=5", types["id"].dataType) and mark_fits("bigint=5", types["i"].dataType)
    assert not mark_fits("2024-01-01 00:00:00", types["t"].dataType) and not mark_fits("timestamp_ntz=2024-01-01", types["t"].dataType)
    with pytest.raises(ValueError):
        mark_text(F.col("a"), types["a"].dataType)


def test_a_mark_that_does_not_fit_gives_a_whole_copy(spark, folder):
    spark.range(10).write.parquet(f"{folder}/lake/facts")
    run(spark, folder, 0, "id")
    spark.range(15).selectExpr("CAST(id AS string) AS id").write.mode("overwrite").parquet(f"{folder}/lake/facts")
    done = run(spark, folder, 1, "id")
    assert manifests.copies_of(manifests.read_manifest(spark, done.path))["facts"].kind == "whole"
    passed, rows = restored(spark, folder, done)
    assert passed and rows.count() == 15


def test_a_late_row_turns_verification_false(spark, folder):
    """A row below the mark that came after the first copy is in no part of the chain."""
    rows = spark.range(30).selectExpr("id * 10 AS id", "id AS v")
    rows.where("id < 200").write.parquet(f"{folder}/lake/facts")
    assert run(spark, folder, 0, "id").verification_passed is True
    rows.where("id >= 200").write.mode("append").parquet(f"{folder}/lake/facts")
    spark.sql("SELECT 55L AS id, 1L AS v").write.mode("append").parquet(f"{folder}/lake/facts")
    done = run(spark, folder, 1, "id")
    found = verification(spark, done)["facts"]
    assert done.verification_passed is False and done.status == "partial_success"
    assert (found.verified, found.total_rows, found.source_total_rows) == (False, 30, 31) and "differ in rows" in found.error


def test_a_changed_row_turns_verification_false(spark, folder):
    spark.range(20).selectExpr("id", "id AS v").write.parquet(f"{folder}/lake/facts")
    run(spark, folder, 0, "id")
    spark.range(30).selectExpr("id", "IF(id = 5, -1, id) AS v").write.mode("overwrite").parquet(f"{folder}/lake/facts")
    assert run(spark, folder, 1, "id", content_check=False).verification_passed is True
    spark.range(40).selectExpr("id", "IF(id = 5, -1, id) AS v").write.mode("overwrite").parquet(f"{folder}/lake/facts")
    done = run(spark, folder, 2, "id", "differential")
    assert done.verification_passed is False and "content" in verification(spark, done)["facts"].error


@pytest.mark.parametrize("damage", ["lost", "doubled", "changed"])
def test_a_restore_is_compared_with_the_whole_chain(spark, folder, damage):
    """A part of the chain that no longer holds what it held is noticed, though every file can be read."""
    for day, upto in ((0, 20), (1, 30)):
        spark.range(upto).selectExpr("id", "id AS v").write.mode("overwrite").parquet(f"{folder}/lake/facts")
        done = run(spark, folder, day, "id")
        first = done if day == 0 else first
    part = spark.createDataFrame(spark.read.parquet(f"{first.path}/facts").collect())
    other = {"lost": part.where("id <> 7"), "doubled": part.union(part.where("id = 7")), "changed": part.selectExpr("id", "IF(id = 7, 8, v) AS v")}[damage]
    other.write.mode("overwrite").parquet(f"{first.path}/facts")
    back = r.restore(spark, RestoreOptions(done.path, f"{folder}/r"))
    assert back.verification_passed is False and back.status == "partial_success"


def test_a_widened_column_keeps_the_sum(spark, folder):
    spark.range(20).selectExpr("CAST(id AS int) AS id", "CAST(id / 4 AS float) AS v").write.parquet(f"{folder}/lake/facts")
    run(spark, folder, 0, "id")
    spark.range(30).selectExpr("id", "CAST(id / 4 AS double) AS v").write.mode("overwrite").parquet(f"{folder}/lake/facts")
    done = run(spark, folder, 1, "id")
    assert done.verification_passed is True
    passed, rows = restored(spark, folder, done)
    assert passed and rows.count() == 30


def folders(path):
    return sorted(x for x in os.listdir(path) if "=" in x)


def test_folder_names_come_back(spark, folder):
    rows = spark.range(60).selectExpr("id", "lpad(CAST(id % 3 AS string), 2, '0') AS m", "CAST(id % 2 AS string) || '.50' AS n")
    rows.write.partitionBy("m", "n").parquet(f"{folder}/lake/facts")
    done = run(spark, folder, 0, None, "full")
    passed, back = restored(spark, folder, done)
    assert passed and folders(f"{folder}/r/facts") == ["m=00", "m=01", "m=02"] and folders(f"{folder}/r/facts/m=00") == ["n=0.50", "n=1.50"]
    assert back.schema == spark.read.parquet(f"{folder}/lake/facts").schema
    assert folders(f"{done.path}/facts") == ["m=00", "m=01", "m=02"]


def test_values_that_look_different_later(spark, folder):
    """01 alone is a number, next to A1 a text; dates, blanks, marks and missing values keep their names too."""
    names = [["01", "2024-01-01"], ["A1", "0x", "1e3", "a b=c/d", None]]
    for day, some in enumerate(names):
        rows = [(10 * day + i, x) for i, x in enumerate(some)]
        spark.createDataFrame(rows, "id long, m string").write.mode("append").partitionBy("m").parquet(f"{folder}/lake/facts")
        done = run(spark, folder, day, "id")
        assert done.verification_passed is True
    passed, back = restored(spark, folder, done)
    assert passed and folders(f"{folder}/r/facts") == folders(f"{folder}/lake/facts")
    assert {(x.id, x.m) for x in back.collect()} == {(10 * d + i, x) for d, some in enumerate(names) for i, x in enumerate(some)}


def test_filters_and_marks_on_partition_columns_are_typed(spark, folder):
    """9 is below 10 as a number: the filter and the mark compare values, the copy keeps names."""
    def write(days):
        for d in days:
            spark.range(3).selectExpr("id").write.parquet(f"{folder}/lake/facts/d={d:03d}")

    write(range(8, 11))
    run(spark, folder, 0, "d", partition_filter="d >= 9")
    write(range(11, 13))
    done = run(spark, folder, 1, "d", partition_filter="d >= 9")
    copy = manifests.copies_of(manifests.read_manifest(spark, done.path))["facts"]
    assert (copy.kind, copy.rows, copy.total_rows, copy.low, copy.high) == ("partial", 6, 12, "int=10", "int=12")
    passed, _ = restored(spark, folder, done)
    assert passed and folders(f"{folder}/r/facts") == ["d=009", "d=010", "d=011", "d=012"]


def test_metadata_is_restored_once(spark, folder):
    spark.range(3).write.parquet(f"{folder}/lake/facts")
    spark.range(3).write.parquet(f"{folder}/lake/other")
    done = run(spark, folder, 0, None, "full", include_logs=True)
    for tables in ("facts,other", "facts", "other"):
        r.restore(spark, RestoreOptions(done.path, f"{folder}/r", tables=tables))
    assert sorted(x.table_name for x in spark.read.json(f"{folder}/r/_table_metadata").collect()) == ["facts", "other"]


def test_one_unreadable_table_costs_few_jobs(spark, folder):
    from keepsake.plans.verify import count_tables

    for i in range(8):
        spark.range(i).write.parquet(f"{folder}/t{i}")
    tables = {f"t{i}": [f"{folder}/t{i}"] for i in range(8)} | {"bad": [f"{folder}/none"]}
    rows = {x.table_name: x for x in count_tables(spark, tables, "parquet").collect()}
    assert [rows[f"t{i}"].rows for i in range(8)] == list(range(8)) and rows["bad"].error and rows["bad"].rows is None
