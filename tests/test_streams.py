"""Streams over split files in several batches give what the batch forms give for closed windows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from keepsake.operators import alerts as batch
from keepsake.streaming import alerts, metrics
from keepsake.streaming.sources import drain, event_stream, run_events

SCHEMA = "execution_id bigint, ts timestamp_ntz, environment string, rule_name string, status string, duration_min double, retries bigint"
BASE = dt.datetime(2024, 1, 1)


def events(n=400, hours=40, seed=3):
    rnd = random.Random(seed)
    rows = [(i, BASE + dt.timedelta(seconds=rnd.randrange(hours * 3600)), rnd.choice("aab"), rnd.choice(["error", "purchase", "error", "view"]),
             rnd.choice(["Failed", "Success"]), float(rnd.randrange(100)), rnd.randrange(2)) for i in range(n)]
    rows.sort(key=lambda r: r[1])
    # The last event is far later, so that everything before it is closed.
    return rows + [(n, BASE + dt.timedelta(hours=hours + 60), "end", k, "Success", 1.0, 0) for k in ("error", "purchase")]


def write(spark, rows, folder, files):
    """Files in time order, rows shuffled inside each; read one file per batch."""
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size:(n + 1) * size]
        random.Random(n).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return event_stream(spark, f"{folder}/in", SCHEMA, files_per_batch=1)


def test_metrics(spark, folder):
    rows = events()
    got = drain(metrics.tumbling_metrics(write(spark, rows, folder, 5), ["environment"]), "m").collect()
    windows = {}
    for i, t, env, _, status, duration, retries in rows:
        if env != "end":
            windows.setdefault((BASE + (t - BASE) // dt.timedelta(days=1) * dt.timedelta(days=1), env), []).append((t, i, status, duration, retries))
    assert {(r.window_start, r.environment) for r in got} == set(windows)
    for r in got:
        group = windows[(r.window_start, r.environment)]
        assert r.runs == len(group) and r.circuit_breaker_trips == sum(s == "Failed" for _, _, s, _, _ in group)
        assert r.last_duration_min == max(group)[3]
        assert r.retry_rate == round(100 * sum(x > 0 for *_, x in group) / len(group), 6)


def test_throttle_equals_batch(spark, folder):
    rows = events(seed=4)
    stream = write(spark, rows, folder, 4)
    got = sorted(r.execution_id for r in drain(alerts.throttled(stream, "rule_name", "execution_id", 3600), "t").collect())
    kept = batch.throttle(spark.createDataFrame(rows, SCHEMA).where("environment <> 'end'"), "rule_name", ["ts", "execution_id"], "1 hour")
    assert got == sorted(r.execution_id for r in kept.collect())


def test_throttle_by_rule_equals_batch(spark, folder):
    """Windows of an hour and of ten minutes, limits of two and one, and a rule without either."""
    rows = events(seed=8)
    limits = F.create_map(F.lit("error"), F.struct(F.lit(3600).cast("bigint"), F.lit(2)), F.lit("purchase"), F.struct(F.lit(600).cast("bigint"), F.lit(1)))

    def stated(df):
        own = limits[F.col("rule_name")]
        return df.withColumns({"throttle_seconds": own["col1"], "throttle_most": own["col2"]})

    stream = stated(write(spark, rows, folder, 4))
    got = drain(alerts.throttled_by_rule(stream, "execution_id"), "r").collect()
    kept = batch.throttle_by_rule(stated(spark.createDataFrame(rows, SCHEMA).where("environment <> 'end'")), ["ts", "execution_id"], 2).collect()
    assert sorted(r.execution_id for r in got) == sorted(r.execution_id for r in kept)
    assert {r.rule_name for r in got if r.window_start is None} == {"view"}
    slow = {}
    for i, t, env, rule, *_ in sorted(rows[:-2], key=lambda r: (r[1], r[0])):
        width = {"error": 3600, "purchase": 600, "view": None}[rule]
        slow.setdefault((rule, (t - BASE) // dt.timedelta(seconds=width) if width else i), []).append(i)
    assert sorted(r.execution_id for r in kept) == sorted(i for (rule, _), ids in slow.items() for i in ids[:{"error": 2}.get(rule, 1)])


def test_the_error_of_the_percentile_is_bounded(spark, folder):
    """Ranks are off by at most n / precision, over many batches; exact when a window has fewer runs than that."""
    rnd = random.Random(9)
    rows = [(i, BASE + dt.timedelta(seconds=i), "a", "view", "Success", round(rnd.lognormvariate(2, 1.5), 3), 0) for i in range(20_000)]
    rows.append((20_000, BASE + dt.timedelta(days=9), "end", "view", "Success", 1.0, 0))
    values = sorted(r[5] for r in rows[:-1])
    stream = write(spark, rows, folder, 6)
    for precision, most in ((40, 20_000 / 40), (100_000, 0)):
        row, = drain(metrics.tumbling_metrics(stream, ["environment"], precision=precision), f"p{precision}").where("environment = 'a'").collect()
        wanted = -(-95 * len(values) // 100)
        low, high = sum(v < row.p95_min for v in values) + 1, sum(v <= row.p95_min for v in values)
        assert max(low - wanted, wanted - high, 0) <= most, (precision, low, high, wanted)


def test_escalation_equals_batch(spark, folder):
    rows = events(seed=5)
    stream = write(spark, rows, folder, 4)
    out = drain(alerts.escalated(stream, "environment", "execution_id", F.col("rule_name") == "error",
                                 F.col("rule_name") == "purchase", salts=3), "e")
    df = spark.createDataFrame(rows, SCHEMA).where("environment <> 'end'")
    expected = batch.escalate(df.where("rule_name = 'error'"), df.where("rule_name = 'purchase'").select("environment", "ts"), "environment")
    assert sorted(r.execution_id for r in out.collect()) == sorted(r.execution_id for r in expected.collect())


def test_duplicates_and_late_rows(spark, folder):
    rows = events(60, hours=2, seed=6)[:-2]
    late = (999, BASE - dt.timedelta(days=3), "a", "error", "Failed", 1.0, 0)
    stream = write(spark, rows + rows[-20:] + [late], folder, 3)
    once = drain(metrics.without_duplicates(stream, ["execution_id"]), "d").collect()
    ids = [r.execution_id for r in once]
    assert len(ids) == len(set(ids)) and set(ids) == {r[0] for r in rows}


def test_posted_events(spark, folder):
    import json
    import os
    os.makedirs(f"{folder}/posted")
    event = {"eventType": "PipelineStart", "pipelineName": "p", "executionId": "1", "correlationId": "c", "environment": "production",
             "timestamp": "2024-01-01T10:00:00", "parameters": {"sourceLakehouse": "l", "backupLocation": "b", "backupMode": "full"}}
    with open(f"{folder}/posted/1.json", "w") as f:
        f.write((json.dumps(event) + "\n") * 3)
    assert run_events(spark, f"{folder}/posted").count() == 3
    once = metrics.without_duplicates(run_events(spark, f"{folder}/posted", streaming=True), ["execution_id", "event_type"])
    row, = drain(once, "posted").collect()
    assert (row.event_type, row.ts, row.backup_mode) == ("PipelineStart", dt.datetime(2024, 1, 1, 10), "full")
