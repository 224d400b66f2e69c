"""Expressions and operators on small fixtures, against brute force where there is something to count."""

import datetime as dt
import random
import statistics
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from keepsake.functions import measures, names, patterns, periods
from keepsake.operators import alerts, cutoff, metrics, reconcile, retention, running, selection
from keepsake.options import RETENTION_PRESETS, RetentionOptions
from keepsake.session import workspace
from keepsake.sources import config
from keepsake.sources.storage import table_statistics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name,strict,lenient", [
    ("backup_2024-01-15_10-30-00_abc123", "2024-01-15 10:30:00", "2024-01-15 10:30:00"),
    ("backup_2024-1-5_1-3-0_zz_yy", "2024-01-05 01:03:00", "2024-01-05 01:03:00"),
    ("backup_2024-01-15_10-30-00", None, "2024-01-15 10:30:00"),
    ("backup_2024-13-15_10-30-00_a", None, None),
    ("backup_2024-02-30_10-30-00_a", None, None),
    ("backup_2024-01-15_10-30-60_a", None, None),
    ("manual_2024-01-15_10-30-00_a", None, None),
    ("_cleanup_reports", None, None),
])
def test_folder_names(spark, name, strict, lenient):
    got = one(spark, F.struct(names.folder_timestamp(F.lit(name)), names.folder_timestamp(F.lit(name), True)))
    assert [None if v is None else str(v) for v in got] == [strict, lenient]


def test_new_folder_parses(spark):
    name = names.new_backup_folder(dt.datetime(2024, 1, 5, 1, 3, 7))
    assert one(spark, names.folder_timestamp(F.lit(name))) == dt.datetime(2024, 1, 5, 1, 3, 7)
    assert len(one(spark, names.folder_id(F.lit(name)))) == 8


@pytest.mark.parametrize("pattern,name,match", [
    ("backup_*", "backup_1", True), ("backup_*", "xbackup_1", False), ("a?c", "abc", True), ("a?c", "ac", False),
    ("a.c", "abc", False), ("a.c", "a.c", True), ("x[1](2)+$", "x[1](2)+$", True), ("*", "", True), ("a\\b", "a\\b", True),
])
def test_globs(spark, pattern, name, match):
    assert one(spark, patterns.matches_any(F.lit(name), [pattern])) is match
    assert one(spark, patterns.matches_any_column(F.lit(name), F.array(F.lit(pattern)))) is match


def test_exclude_wins_and_empty_include_keeps_all(spark):
    assert one(spark, patterns.selected(F.lit("a"), ["a"], ["a"])) is False
    assert one(spark, patterns.selected(F.lit("a"), [], [])) is True
    assert one(spark, patterns.matches_any(F.lit("a"), [])) is False


def test_calendar_equals_python(spark):
    start = dt.datetime(2019, 12, 25, 23, 59, 59)
    rows = spark.range(800).select(F.timestamp_add("DAY", F.col("id"), F.lit(str(start)).cast("timestamp_ntz")).alias("ts"))
    for r in rows.select("ts", periods.week_key(F.col("ts")).alias("w"), periods.day_key(F.col("ts")).alias("d"),
                         periods.layout(F.col("ts"), periods.REPORT_LAYOUT).alias("l")).collect():
        assert (r.w, r.d, r.l) == (r.ts.strftime("%Y-W%U"), r.ts.strftime("%Y-%m-%d"), r.ts.strftime("%Y%m%d_%H%M%S"))


@pytest.mark.parametrize("ts", ["2024-01-01 23:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00.5", "2024-01-09 00:00:00"])
def test_age_is_elapsed_days(spark, ts):
    as_of = dt.datetime(2024, 1, 2)
    expected = (as_of - dt.datetime.fromisoformat(ts)).days
    assert one(spark, periods.age_days(F.lit(ts).cast("timestamp_ntz"), periods.as_of_column(as_of))) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_keys_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        ts = F.lit("2024-03-10 02:30:00").cast("timestamp_ntz")  # does not exist in New York
        row = one(spark, F.struct(names.folder_name(ts, F.lit("x")), periods.day_key(ts), periods.week_key(ts),
                                  periods.epoch_second(ts), periods.age_days(ts, periods.as_of_column("2024-03-11 02:30:00"))))
        assert list(row) == ["backup_2024-03-10_02-30-00_x", "2024-03-10", "2024-W10", 1710037800, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("text,seconds", [("PT15M", 900), ("PT24H", 86400), ("PT1H30M", 5400), ("P1DT1S", 86401), ("15M", None)])
def test_iso_durations(spark, text, seconds):
    assert one(spark, periods.iso_seconds(F.lit(text))) == seconds


def test_bands_and_severity(spark):
    bands = [one(spark, measures.band(F.lit(v), measures.HEALTH_BANDS)) for v in (0, 75, 84.9, 85, 95, 100, 101)]
    assert bands == ["critical", "warning", "warning", "good", "excellent", "excellent", None]
    low_is_bad = [one(spark, metrics.metric_severity("pipeline_success_rate", F.lit(v))) for v in (99.0, 95.0, 90.0)]
    high_is_bad = [one(spark, metrics.metric_severity("retry_rate", F.lit(v))) for v in (9.0, 10.0, 20.0)]
    assert low_is_bad == high_is_bad == ["ok", "warning", "critical"]


@pytest.mark.parametrize("failed,ok,status", [(0, 0, "success"), (0, 3, "success"), (1, 2, "partial_success"), (2, 0, "failed")])
def test_run_status(spark, failed, ok, status):
    assert one(spark, measures.run_status(F.lit(failed), F.lit(ok))) == status


def test_rule_conditions(spark):
    got = [tuple(one(spark, alerts.parse_condition(F.lit(text)))) for text in
           ("BackupStatus == 'Failed'", "StorageUsagePercent > 80", "nonsense")]
    assert got == [("BackupStatus", "==", None, "Failed"), ("StorageUsagePercent", ">", 80.0, None), (None, None, None, None)]


def test_config_documents(spark, folder):
    with open(f"{folder}/monitoring.json", "w") as f:
        f.write('{"m": {"metrics": [{"name": "d", "type": "duration", "aggregation": "percentile_95", "timeWindow": "PT24H",'
                '"threshold": {"warning": "PT1H30M", "critical": "PT2H"}}, {"name": "r", "timeWindow": "PT1H",'
                '"threshold": {"warning": 95, "critical": 90}}]}, "l": [{"name": "a", "workspaceId": "w", "tableFilter": "*"}]}')
    documents = config.read_documents(spark, folder)
    rules = {r["name"]: (r.window_seconds, r.warning, r.critical) for r in config.metric_rules(documents, "$.m.metrics").collect()}
    assert rules == {"d": (86400, 5400.0, 7200.0), "r": (3600, 95.0, 90.0)}
    assert config.lakehouse_list(documents, "$.l").first().tableFilter == "*"


def test_presets_and_settings(spark):
    assert RETENTION_PRESETS["production"].max_count == 20
    rows = {r.environment: (r.backupMode, r.retentionDays) for r in selection.environment_settings(spark).collect()}
    assert rows == {"development": ("incremental", 7), "staging": ("full", 14), "production": ("full", 90)}


@pytest.fixture(params=[10**6, 1])
def task_limit(request, monkeypatch):
    monkeypatch.setattr(cutoff, "ROWS_IN_ONE_TASK", request.param)


def runs(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(0, 200000, 50), microseconds=rnd.choice([0, 0, 7])),
             rnd.choice("aaab"), rnd.choice([1, 5, 5, 5, 60, 61, 600])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "execution_id bigint, ts timestamp_ntz, k string, v bigint")


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_percentile(spark, task_limit, share):
    rows, df = runs(spark)
    got = {r.k: r.p for r in metrics.exact_percentile(df, ["k"], "v", share, "p").collect()}
    for key in "ab":
        values = sorted(v for _, _, k, v in rows if k == key)
        position = (len(values) - 1) * share
        low, high = values[int(position)], values[min(int(position) + 1, len(values) - 1)]
        assert got[key] == pytest.approx(low + (high - low) * (position - int(position)))


def test_history(spark, task_limit):
    rows, df = runs(spark)
    buckets = [periods.day_key(F.col("ts")), periods.epoch_second(F.col("ts"))]
    order = ["ts", "execution_id"]
    sums = {r.execution_id: r.prior_v for r in running.prior_sums(df, ["k"], order, buckets, {"v": F.col("v")}).collect()}
    nullable = df.withColumn("v", F.when(F.col("v") != 5, F.col("v")))
    before = {r.execution_id: r.before for r in running.prior_value(nullable, ["k"], order, buckets, "v", "before").collect()}
    total, last = {}, {}
    for i, _, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert sums[i] == total.get(k, 0) and before[i] == last.get(k)
        total[k], last[k] = total.get(k, 0) + v, None if v == 5 else v


def test_duration_anomalies(spark, task_limit):
    rows, df = runs(spark, 120)
    got = {r.execution_id: (r.over_limit, r.over_baseline)
           for r in metrics.duration_anomalies(df, ["k"], F.col("v"), limit_seconds=500).collect()}
    seen = {}
    for i, _, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        past = seen.setdefault(k, [])
        over = len(past) >= 2 and v > statistics.fmean(past) + 2 * statistics.stdev(past)
        assert got[i] == (v > 500, over)
        past.append(v)


def test_escalation_and_throttling(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.choice([0, 900, 1799, 1800, 1801, 3600, 5400, 9000, 12345]) + rnd.choice([0, 1]),
                                    microseconds=rnd.choice([0, 1])), rnd.choice("ab"), rnd.choice(["open", "close"]))
            for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, k string, what string")
    opened, closed = df.where("what = 'open'").drop("what"), df.where("what = 'close'").select("k", "ts")
    got = sorted(r.id for r in alerts.escalate(opened, closed, "k").collect())
    assert got == sorted(i for i, t, k, w in rows if w == "open" and not any(
        w2 == "close" and k2 == k and t <= t2 <= t + dt.timedelta(minutes=30) for _, t2, k2, w2 in rows))
    kept = sorted(r.id for r in alerts.throttle(df, "k", ["ts", "id"]).collect())
    windows = {}
    for i, t, k, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        windows.setdefault((k, (t - base) // dt.timedelta(minutes=15)), []).append(i)
    assert kept == sorted(i for ids in windows.values() for i in ids[:3])


def test_reconcile_and_checksum(spark):
    source = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "table_name string, rows bigint")
    copy = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "table_name string, rows bigint")
    got = {r.table_name: (r.verified, r.error) for r in reconcile.reconcile(source, copy, ["table_name"]).collect()}
    assert got == {"a": (True, None), "b": (False, "row counts differ"), "c": (False, "missing in backup"), "d": (False, "missing in source")}
    assert reconcile.all_verified(spark.createDataFrame([], "k string, source_rows bigint, backup_rows bigint, verified boolean"), []).first().all_verified
    df = spark.range(100).selectExpr("id", "map('k', id) AS m", "array(id) AS a", "CAST(NULL AS STRING) AS s")
    first = reconcile.content_checksum(df).first()
    assert first == reconcile.content_checksum(df.repartition(7).orderBy(F.col("id").desc())).first()
    assert first != reconcile.content_checksum(df.withColumn("a", F.array(F.when(F.col("id") == 3, 4).otherwise(F.col("id"))))).first()


def test_changed_rows(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "id bigint, s string, d double")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, "d", None)], "id bigint, s string, d double")
    assert sorted(r.id for r in reconcile.changed_rows(new, old, ["id"]).collect()) == [2, 4]


def test_sample_is_repeatable(spark):
    df = spark.range(4000).selectExpr("concat('backup_', id) AS folder_name")
    one_way = {r.folder_name for r in reconcile.sample_for_test(df, 5, "s").collect()}
    assert one_way == {r.folder_name for r in reconcile.sample_for_test(df.repartition(13), 5, "s").collect()}
    assert 120 < len(one_way) < 280


def test_table_statistics(spark, folder):
    import os
    spark.range(100).repartition(3).write.parquet(f"{folder}/t")
    row = table_statistics(spark, {"t": f"{folder}/t"}, "parquet").first()
    sizes = [os.path.getsize(f"{folder}/t/{f}") for f in os.listdir(f"{folder}/t") if f.endswith(".parquet") and f[0] not in "._"]
    assert (row.table_name, row.num_files, row.size_bytes) == ("t", 3, sum(sizes))


def test_hashes_see_where_nulls_are(spark):
    one = spark.sql("SELECT 1 AS k, 5 AS a, CAST(NULL AS int) AS b, array(1, NULL) AS c, named_struct('m', map('x', array(map('y', 1)))) AS d")
    two = spark.sql("SELECT 1 AS k, CAST(NULL AS int) AS a, 5 AS b, array(1, NULL) AS c, named_struct('m', map('x', array(map('y', 1)))) AS d")
    three = spark.sql("SELECT 1 AS k, 5 AS a, CAST(NULL AS int) AS b, array(NULL, 1) AS c, named_struct('m', map('x', array(map('y', 1)))) AS d")
    sums = [reconcile.content_checksum(x).first().checksum for x in (one, two, three)]
    assert len(set(sums)) == 3
    assert reconcile.changed_rows(two, one, ["k"]).count() == 1 and reconcile.changed_rows(one, one, ["k"]).isEmpty()


@pytest.mark.parametrize("limit", [10**6, 1])
def test_null_groups_are_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(cutoff, "ROWS_IN_ONE_TASK", limit)
    rows = spark.sql("""SELECT * FROM VALUES (CAST(NULL AS string), 'backup_1', timestamp_ntz '2024-01-01 00:00:00', 10L, 9L), (NULL, 'backup_2', timestamp_ntz '2024-01-02 00:00:00', 10L, 8L),
        (NULL, 'backup_3', timestamp_ntz '2024-01-03 00:00:00', 10L, 7L), (NULL, 'backup_4', timestamp_ntz '2024-01-04 00:00:00', 10L, 6L)
        AS t(location, folder_name, ts, size_bytes, age_days)""")
    for options in (RetentionOptions("count_based", max_count=2), RetentionOptions("size_based", max_size_bytes=20)):
        plan = retention.plan_deletions(rows, options)
        assert sorted(x.folder_name for x in plan.where("reason IS NOT NULL").collect()) == ["backup_1", "backup_2"]
    grown = metrics.size_growth(rows, ["location"]).collect()
    assert sorted((x.folder_name, x.previous_bytes) for x in grown) == [("backup_1", None), ("backup_2", 10), ("backup_3", 10), ("backup_4", 10)]
    values = spark.sql("SELECT * FROM VALUES ('a', CAST(NULL AS double)), ('a', NULL), (NULL, 0.25D), (NULL, 0.75D) AS t(k, v)")
    assert {x.k: x.p for x in metrics.exact_percentile(values, ["k"], "v", 0.5, "p").collect()} == {"a": None, None: 0.5}


def test_escalation_by_rule(spark):
    """Each rule's own delay, against loops; boundaries of bins and of delays to the microsecond."""
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.choice([0, 60, 599, 600, 601, 1800, 3600, 5400, 7199, 7200, 9000]) + rnd.choice([0, 1]), microseconds=rnd.choice([0, 1])),
             rnd.choice("ab"), rnd.choice(["open", "open", "close"]), rnd.choice([600, 1800, 7200, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, k string, what string, escalate_seconds bigint")
    opened, closed = df.where("what = 'open'"), df.where("what = 'close'").select("k", "ts")
    got = alerts.escalate_by_rule(opened, closed, "k", [600, 1800, 7200])
    assert got.columns == ["k", "id", "ts", "what", "escalate_seconds"] or set(got.columns) == {"k", "id", "ts", "what", "escalate_seconds"}
    assert sorted(r.id for r in got.collect()) == sorted(i for i, t, k, w, d in rows if w == "open" and d and not any(
        w2 == "close" and k2 == k and t <= t2 <= t + dt.timedelta(seconds=d) for _, t2, k2, w2, _ in rows))
    assert alerts.escalate_by_rule(opened.where("escalate_seconds IS NULL"), closed, "k", []).collect() == []


def test_aggregations_by_name(spark):
    rows = [(k, dt.datetime(2024, 1, 1, h), i, float(v)) for i, (k, h, v) in enumerate([("a", 1, 5), ("a", 3, 2), ("a", 3, 9), ("a", 2, 100), ("b", 1, 7)])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, value double")
    want = {"average": 29.0, "sum": 116.0, "count": 4.0, "minimum": 2.0, "maximum": 100.0, "latest": 9.0, "percentile_50": 7.0, "percentile_95": 86.35}
    for name, value in want.items():
        got = {r.k: r.value for r in metrics.aggregated(df, ["k"], "value", name, ["ts", "id"]).collect()}
        assert got["a"] == pytest.approx(value) and got["b"] == (1.0 if name == "count" else 7.0), name
    for bad in ("median", "percentile_", "percentile_101"):
        with pytest.raises(ValueError):
            metrics.aggregated(df, ["k"], "value", bad, ["ts"])


def test_forecast_interval(spark):
    """Tabulated quantiles of Student's distribution, and the prediction interval of a line from its textbook formula."""
    table = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 8: 2.306, 10: 2.228, 30: 2.042, 1000: 1.962}
    rows = spark.createDataFrame([(float(n),) for n in table], "n double").select("n", metrics.student_quantile(F.col("n"), 1.959964).alias("t")).collect()
    for r in rows:
        assert r.t == pytest.approx(table[int(r.n)], rel=2.5e-3 if r.n == 3 else 1e-3), r.n
    xs, ys = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2.1, 3.9, 6.2, 7.8, 10.1, 12.2, 13.8, 16.1, 18.0, 20.2]
    got = metrics.forecast(spark.createDataFrame([("s", x, y) for x, y in zip(xs, ys)] + [("t", 1, 1.0), ("t", 2, 2.0)], "k string, day_number bigint, v double"),
                           ["k"], "v", horizon_days=5, z=1.959964).collect()
    row = next(r for r in got if r.k == "s")
    n, mx, my = 10, sum(xs) / 10, sum(ys) / 10
    sxx = sum((x - mx) ** 2 for x in xs)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sxx
    rest = sum((y - my - slope * (x - mx)) ** 2 for x, y in zip(xs, ys)) / (n - 2)
    half = 2.306 * (rest * (1 + 1 / n + (15 - mx) ** 2 / sxx)) ** 0.5
    assert row.forecast == pytest.approx(my + slope * (15 - mx)) and row.upper - row.forecast == pytest.approx(half, rel=1e-3)
    assert next(r for r in got if r.k == "t").upper is None


@pytest.mark.parametrize("master, checkpoints, warehouse, expected", [
    ("local[8]", None, "file:/w", "file:/w/_keepsake"), ("yarn", None, "s3a://b/w/", "s3a://b/w/_keepsake"),
    ("yarn", "file:/c/", "file:/w", "file:/c"), ("yarn", None, "file:/w", None), ("spark://h:1", None, "/w", None)])
def test_the_workspace_is_shared(master, checkpoints, warehouse, expected):
    """Executors on other machines never get a folder of the driver's machine, unless the cluster names it."""
    settings = {"spark.checkpoint.dir": checkpoints, "spark.sql.warehouse.dir": warehouse}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *_: settings[key]), sparkContext=SimpleNamespace(master=master))
    if expected:
        assert workspace(session) == expected
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workspace(session)
