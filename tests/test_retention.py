"""Planners against loops on random catalogs, with small groups and with groups too large for one task."""

import random

import pytest

import loops
from keepsake.operators import cutoff
from keepsake.operators import retention as ret
from keepsake.operators.preservation import with_preservation
from keepsake.options import PreserveOptions, RetentionOptions

SCHEMA = "location string, folder_name string, ts timestamp_ntz, size_bytes bigint, age_days bigint"


@pytest.fixture(params=["one window", "one level", "all levels"])
def task_limit(request, monkeypatch):
    """Rows that count as too many for one task: none, a few, nearly all."""
    monkeypatch.setattr(cutoff, "ROWS_IN_ONE_TASK", {"one window": 10**6, "one level": 30, "all levels": 1}[request.param])
    return request.param


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def by_location(rows):
    out = {}
    for r in rows:
        out.setdefault(r["location"], []).append(r)
    return out


CASES = [
    ("age_based", 30, 1, 1, ("none", 0, 0, 0)),
    ("count_based", 1, 7, 1, ("daily", 3, 0, 0)),
    ("size_based", 1, 1, 200, ("weekly", 1, 2, 0)),
    ("size_based", 1, 1, 1, ("monthly", 20, 20, 20)),
    ("advanced", 60, 20, 300, ("monthly", 2, 2, 2)),
    ("advanced", 10, 3, 10, ("monthly", 0, 0, 1)),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}-{c[1]}-{c[3]}")
def test_plans_equal_loops(spark, task_limit, case):
    mode, days, count, cap, (policy, d, w, m) = case
    rows = loops.random_catalog(random.Random(hash((mode, days, cap)) % 1000), 120)
    options = RetentionOptions(mode, days, count, cap, PreserveOptions(policy, d, w, m))
    got = {r.folder_name: (r.preserved, r.reason) for r in ret.plan_deletions(frame(spark, rows), options).collect()}
    for group in by_location(rows).values():
        kept = loops.preserved(group, policy, d, w, m)
        reason = loops.plan(group, mode, days, count, cap, kept)
        for r in group:
            name = r["folder_name"]
            assert got[name] == (name in kept, reason.get(name)), name


@pytest.mark.parametrize("target", [0, 1, 60, 10**9])
def test_emergency_equals_loop(spark, task_limit, target):
    rows = loops.random_catalog(random.Random(target), 90)
    got = {r.folder_name for r in ret.emergency_plan(frame(spark, rows), target).where("selected").collect()}
    assert got == {n for group in by_location(rows).values() for n in loops.emergency(group, target)}


def test_one_second_holds_everything(spark, task_limit):
    """All backups of one location at the same second: only the ids tell them apart."""
    rows = loops.random_catalog(random.Random(5), 80)
    for i, r in enumerate(rows):
        r.update(location="a", ts=rows[0]["ts"], size_bytes=10, folder_name=f"backup_2023-11-20_00-00-00_{i * 811:08x}")
    options = RetentionOptions("advanced", 1000, 37, 200)
    got = {r.folder_name: r.reason for r in ret.plan_deletions(frame(spark, rows), options).collect()}
    expected = loops.plan(rows, "advanced", 1000, 37, 200, set())
    assert got == {r["folder_name"]: expected.get(r["folder_name"]) for r in rows}


def test_empty_and_single(spark, task_limit):
    options = RetentionOptions("advanced", 1, 1, 1, PreserveOptions("monthly"))
    assert ret.plan_deletions(frame(spark, []), options).collect() == []
    one = loops.random_catalog(random.Random(1), 1)
    row = ret.plan_deletions(frame(spark, one), options).collect()[0]
    assert row.preserved and row.reason is None and row.keep_daily and row.keep_weekly and row.keep_monthly


def test_zero_counts_keep_none(spark):
    rows = loops.random_catalog(random.Random(2), 20)
    assert with_preservation(frame(spark, rows), PreserveOptions("monthly", 0, 0, 0)).where("preserved").isEmpty()


def test_preview_leaves_preservation_out_by_default(spark, task_limit):
    rows = loops.random_catalog(random.Random(3), 60)
    out = ret.preview(frame(spark, rows), {"a": RetentionOptions("count_based", max_count=4),
                                           "b": RetentionOptions("size_based", max_size_bytes=20)}).collect()
    for r in out:
        group = by_location(rows)[r.location]
        reason = loops.plan(group, "count_based" if r.scenario == "a" else "size_based", 0, 4, 20, set())
        assert (r.to_delete, r.preserved, r.discovered) == (len(reason), 0, len(group))
        assert r.freed_bytes == sum(x["size_bytes"] for x in group if x["folder_name"] in reason)


def test_summary_says_whether_the_cap_is_met(spark):
    rows = loops.random_catalog(random.Random(4), 60)
    plan = ret.plan_deletions(frame(spark, rows), RetentionOptions("size_based", max_size_bytes=1, preserve=PreserveOptions("daily", 20)))
    for r in ret.plan_summary(plan, cap=1).collect():
        assert r.cap_met == (r.kept_bytes <= 1)
        assert r.discovered == r.to_delete + r.kept


def test_increments_keep_what_they_build_on(spark):
    plan = spark.sql("""SELECT * FROM VALUES
        ('l', 'full', named_struct('chain', array()), 'age'), ('l', 'inc1', named_struct('chain', array('full')), 'age'),
        ('l', 'inc2', named_struct('chain', array('full', 'inc1')), NULL), ('l', 'old', NULL, 'age')
        AS t(location, folder_name, manifest, reason)""")
    hidden = spark.sql("SELECT 'l' AS location, 'manual' AS folder_name, named_struct('chain', array('base')) AS manifest")
    plan = plan.union(spark.sql("SELECT 'l', 'base', named_struct('chain', CAST(array() AS array<string>)), 'age'"))
    found = plan.where("manifest IS NOT NULL").select("location", "folder_name", "manifest").union(hidden)
    assert {r.folder_name: r.reason for r in ret.without_needed(plan.drop("manifest"), found).collect()} == {
        "base": None,
        "full": None, "inc1": None, "inc2": None, "old": "age"}
