"""Throttling and escalation as stateful streams.

Both give, for closed windows, exactly what their batch forms give. One rule or key may carry a
third of all events, so each task first reduces its rows to the few that can matter before they are
grouped, and rows that must be held are spread over salts. State is kept per rule or key and block
of windows; it holds the open windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from keepsake.functions.periods import epoch_us, event_time, from_epoch_us
from keepsake.streaming.metrics import WATERMARK


def _watermarked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", event_time(F.col("us"))).withWatermark("event_time", WATERMARK)


def throttled(alerts: DataFrame, rule: str, identity: str, interval_seconds: int = 900, most: int = 3,
              windows_in_block: int = 96) -> DataFrame:
    """The first ``most`` alerts per rule and tumbling window, once the window has closed.

    ``identity`` is a bigint that decides between equal times.
    """
    stated = alerts.select(F.col(rule).alias("rule_name"), "ts", identity, F.lit(interval_seconds).cast("bigint").alias("throttle_seconds"),
                           F.lit(most).alias("throttle_most"))
    return _limited(stated, identity, windows_in_block).withColumnRenamed("rule_name", rule)


def throttled_by_rule(hits: DataFrame, identity: str, windows_in_block: int = 96) -> DataFrame:
    """Hits of ``match_rules`` on a stream, each rule with its own window and limit: ``rule_name, window_start, ts, identity``.

    Limited rules give their first hits once a window has closed; hits of rules without a limit pass at once,
    without window_start.
    """
    stated = F.col("throttle_seconds").isNotNull() & F.col("throttle_most").isNotNull()
    free = hits.where(~stated).select("rule_name", F.lit(None).cast("timestamp_ntz").alias("window_start"), "ts", F.col(identity).cast("bigint").alias(identity))
    return _limited(hits.where(stated), identity, windows_in_block).unionByName(free)


def _limited(alerts: DataFrame, identity: str, windows_in_block: int) -> DataFrame:
    def earliest(batches):
        # Rows beyond the first few of their own batch cannot be among the first few of the window.
        for batch in batches:
            batch = batch.sort_values(["us", "id"])
            yield batch[batch.groupby(["rule", "start"], dropna=False, sort=False).cumcount() < batch["most"]]

    def merge(key, batches, state):
        import pandas as pd

        rule, width, most = key[0], int(key[1]), int(key[2])
        windows = {}
        held = zip(*state.get) if state.exists else []
        for row in held:
            windows.setdefault(row[0], []).append(row[1:])
        for batch in batches:
            for start, us, i in zip(batch["start"].tolist(), batch["us"].tolist(), batch["id"].tolist()):
                windows.setdefault(start, []).append((us, i))
        best = {start: sorted(rows)[:most] for start, rows in windows.items()}
        now = state.getCurrentWatermarkMs()
        closed = [(start, us, i) for start, rows in best.items() if (start + width) // 1000 <= now for us, i in rows]
        still_open = [(start, us, i) for start, rows in best.items() if (start + width) // 1000 > now for us, i in rows]
        if still_open:
            state.update(tuple(map(list, zip(*still_open))))
            state.setTimeoutTimestamp((min(start for start, _, _ in still_open) + width) // 1000)
        elif state.exists:
            state.remove()
        if closed:
            starts, times, ids = zip(*closed)
            yield pd.DataFrame({"rule": rule, "start": starts, "us": times, "id": ids})

    us, width = epoch_us(F.col("ts")), F.col("throttle_seconds").cast("bigint") * 1_000_000
    rows = alerts.select(F.col("rule_name").alias("rule"), width.alias("width"), F.col("throttle_most").cast("bigint").alias("most"),
                         (us - F.pmod(us, width)).alias("start"), us.alias("us"), F.col(identity).cast("bigint").alias("id"))
    reduced = _watermarked(rows.mapInPandas(earliest, rows.schema))
    block = F.floor(F.col("start") / (F.col("width") * windows_in_block)).cast("bigint")
    kept = reduced.withColumn("block", block).groupBy("rule", "width", "most", "block").applyInPandasWithState(
        merge, "rule string, start bigint, us bigint, id bigint", "starts array<bigint>, us array<bigint>, ids array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.col("rule").alias("rule_name"), from_epoch_us(F.col("start")).alias("window_start"),
                       from_epoch_us(F.col("us")).alias("ts"), F.col("id").alias(identity))


def escalated(events: DataFrame, key: str, identity: str, opens: Column, closes: Column, delay_seconds: int = 1800,
              salts: int = 8, bins_in_block: int = 48) -> DataFrame:
    """Opening events without a closing event of the same key within the delay, when that is certain.

    Bins as in the batch form: a bin of openings needs the bin's last closing and the next bin's
    first. Closings are reduced to these two per task and copied to every salt; openings, which must
    be held until the bin after theirs is over, are spread over the salts.
    """
    width = delay_seconds * 1_000_000
    never = 2**62

    def reduce_closings(batches):
        import pandas as pd

        for batch in batches:
            opened, closed = batch[batch["opening"]], batch[~batch["opening"]]
            by_bin = closed.groupby(["key", "bin"], dropna=False)["us"]
            ends = closed.loc[pd.concat([by_bin.idxmin(), by_bin.idxmax()]).drop_duplicates()]
            yield pd.concat([opened, ends])

    def decide(group, batches, state):
        import pandas as pd

        ids, times, bins, lasts, nexts = state.get if state.exists else ([], [], [], [], [])
        pending = list(zip(ids, times))
        last, first_next = dict(zip(bins, lasts)), dict(zip(bins, nexts))
        for batch in batches:
            for kind, b, i, at in zip(batch["kind"].tolist(), batch["bin"].tolist(), batch["id"].tolist(), batch["us"].tolist()):
                if kind == "open":
                    pending.append((i, at))
                elif kind == "here":
                    last[b] = max(last.get(b, -1), at)
                else:
                    first_next[b] = min(first_next.get(b, never), at)

        def waits(i, at):
            b = at // width
            return last.get(b, -1) < at and first_next.get(b, never) > at + width

        now = state.getCurrentWatermarkMs()

        def deadline(b):
            return (b + 2) * width // 1000

        pending = [(i, at) for i, at in pending if waits(i, at)]
        due = [(i, at) for i, at in pending if deadline(at // width) <= now]
        pending = [(i, at) for i, at in pending if deadline(at // width) > now]
        bins = [b for b in sorted(set(last) | set(first_next)) if deadline(b) > now]
        if pending or bins:
            state.update(([i for i, _ in pending], [at for _, at in pending], bins,
                          [last.get(b, -1) for b in bins], [first_next.get(b, never) for b in bins]))
            state.setTimeoutTimestamp(deadline(min(bins + [at // width for _, at in pending])))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame({"key": group[0], "id": [i for i, _ in due], "us": [at for _, at in due]})

    us = epoch_us(F.col("ts"))
    rows = events.where(opens | closes).select(
        F.col(key).alias("key"), F.floor(us / F.lit(width)).cast("bigint").alias("bin"), us.alias("us"),
        F.col(identity).cast("bigint").alias("id"), opens.alias("opening"))
    reduced = _watermarked(rows.mapInPandas(reduce_closings, rows.schema))

    def copy(kind: str, bin_number: Column, salt: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), bin_number.alias("bin"), salt.cast("int").alias("salt"))

    bin_number = F.col("bin")
    to_all = [copy(kind, at, F.lit(s)) for s in range(salts) for kind, at in (("here", bin_number), ("next", bin_number - 1))]
    targets = F.when(F.col("opening"), F.array(copy("open", bin_number, F.pmod("id", F.lit(salts))))).otherwise(F.array(*to_all))
    spread = reduced.select("key", "us", "id", "event_time", F.explode(targets).alias("t")).select("key", "us", "id", "event_time", "t.*")
    block = F.floor(F.col("bin") / F.lit(bins_in_block)).cast("bigint")
    late = spread.withColumn("block", block).groupBy("key", "block", "salt").applyInPandasWithState(
        decide, "key string, id bigint, us bigint",
        "ids array<bigint>, times array<bigint>, bins array<bigint>, lasts array<bigint>, nexts array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)
    return late.select(F.col("key").alias(key), F.col("id").alias(identity), from_epoch_us(F.col("us")).alias("ts"))
