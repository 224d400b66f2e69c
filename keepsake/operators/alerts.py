"""Alert rules against events, throttling and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions import measures, periods


def parse_condition(condition: Column) -> Column:
    """Struct (field, op, threshold, literal) of text such as "StorageUsagePercent > 80"."""
    form = r"^\s*(\w+)\s*(==|!=|>=|<=|>|<)\s*(?:'([^']*)'|(-?[0-9.]+))\s*$"

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(condition, form, group), F.lit(""))

    return F.struct(part(1).alias("field"), part(2).alias("op"),
                    part(4).cast("double").alias("threshold"), part(3).alias("literal"))


OPERATORS = ("==", "!=", ">=", "<=", ">", "<")


def conditions(condition: Column) -> Column:
    """All conditions of a rule as an array of (field, op, threshold, literal); null if it cannot be read.

    A rule states a text ("Field > 80") or an object: fields with a value to equal or with an operator
    and a value, or a ``metric`` with its operator and value. Durations such as PT2H count in seconds.
    """

    def stated(field: Column, op: Column, value: Column) -> Column:
        number = F.coalesce(value.try_cast("double"), periods.iso_seconds(value).cast("double"))
        return F.struct(field.alias("field"), op.alias("op"), number.alias("threshold"), F.when(number.isNull(), value).alias("literal"))

    parts = F.from_json(condition, "map<string,string>")
    nested = lambda e: F.from_json(e["value"], "operator string, value string")
    each = F.transform(F.map_entries(parts), lambda e: F.when(F.startswith(e["value"], F.lit("{")), stated(e["key"], nested(e)["operator"], nested(e)["value"]))
                       .otherwise(stated(e["key"], F.lit("=="), e["value"])))
    metric = F.array(stated(parts["metric"], parts["operator"], parts["value"]))
    text = parse_condition(condition)
    return F.when(F.startswith(F.ltrim(condition), F.lit("{")), F.when(parts["metric"].isNotNull(), metric).otherwise(each)).when(
        text["field"].isNotNull(), F.array(text))


def parsed_rules(rules: DataFrame, fields: list[str]) -> DataFrame:
    """Rules with their ``conditions`` and ``problem``: why a rule can never fire, null if it can."""
    rules = rules.withColumn("conditions", conditions(F.col("condition")))
    strange = F.filter("conditions", lambda c: ~F.coalesce(c["op"].isin(*OPERATORS), F.lit(False)) | (c["threshold"].isNull() & c["literal"].isNull()))
    absent = F.filter("conditions", lambda c: ~F.coalesce(c["field"].isin(*fields), F.lit(False)))
    problem = (F.when(F.coalesce(F.size("conditions"), F.lit(0)) < 1, F.lit("condition not readable"))
               .when(F.size(strange) > 0, F.concat(F.lit("operator or value not readable: "), F.coalesce(strange[0]["field"], F.lit("?"))))
               .when(F.size(absent) > 0, F.concat(F.lit("field not offered: "), F.coalesce(absent[0]["field"], F.lit("?")))))
    return rules.withColumn("problem", problem)


def rejected_rules(rules: DataFrame, fields: list[str]) -> DataFrame:
    """``rule_name, condition, problem`` of the rules that ``match_rules`` cannot apply."""
    return parsed_rules(rules, fields).where("problem IS NOT NULL").select("rule_name", "condition", "problem")


def fires(number: Column, text: Column, op: Column, threshold: Column, literal: Column) -> Column:
    """A numeric or a text comparison, whichever the rule states."""
    numeric = measures.compare(number, op, threshold)
    textual = measures.compare(text, op, literal)
    return F.coalesce(F.when(threshold.isNotNull(), numeric).otherwise(textual), F.lit(False))


def match_rules(events: DataFrame, fields: dict[str, tuple[Column, Column]], rules: DataFrame) -> DataFrame:
    """Events that meet all conditions of a rule of their environment (any, where a rule names none).

    ``fields`` names what an event offers as (number, text). Rules come from a configuration file, their
    size is its size; those that cannot be applied are listed by ``rejected_rules``. A rule is joined by
    the field of its first condition, so no event meets a rule that asks for nothing it has. Works on
    batch and streaming events.
    """
    offered = F.array(*[
        F.struct(F.lit(name).alias("field"), number.cast("double").alias("number"), text.cast("string").alias("text"))
        for name, (number, text) in fields.items()])
    known = parsed_rules(rules, list(fields)).where("problem IS NULL")
    kept = [c for c in ("throttle_seconds", "throttle_most", "escalate_seconds") if c in rules.columns]
    known = known.select("rule_name", "severity", "environments", "conditions", F.col("conditions")[0]["field"].alias("field"), *kept)
    offers = events.withColumn("_offered", F.map_from_entries(F.transform(offered, lambda o: F.struct(o["field"], o))))
    offers = offers.withColumn("field", F.explode(F.map_keys("_offered")))
    here = F.col("environments").isNull() | F.array_contains("environments", F.col("environment"))
    met = F.forall("conditions", lambda c: fires(F.col("_offered")[c["field"]]["number"], F.col("_offered")[c["field"]]["text"], c["op"], c["threshold"], c["literal"]))
    return offers.join(known, "field").where(here & met).drop("environments", "conditions", "_offered")


def largest_limit(rules: DataFrame) -> int:
    """The largest ``throttle_most`` of the rules, which have the size of their configuration file; 0 without any."""
    return rules.agg(F.max("throttle_most")).first()[0] or 0


def throttle_by_rule(hits: DataFrame, order: list[str], largest: int) -> DataFrame:
    """At most ``throttle_most`` hits per rule and window of ``throttle_seconds``, the earliest; all where a rule states neither.

    ``largest`` is the largest limit of any rule. As a number in the plan it lets Spark keep that many rows per
    group in each task before the shuffle; each rule's own limit then holds on what is left.
    """
    width = F.col("throttle_seconds") * 1_000_000
    start = F.when(width.isNotNull(), periods.epoch_us(F.col("ts")) - F.pmod(periods.epoch_us(F.col("ts")), width)).otherwise(periods.epoch_us(F.col("ts")))
    numbered = hits.withColumn("_start", start)
    # Rules without a limit never enter the window.
    limited = numbered.where("throttle_seconds IS NOT NULL AND throttle_most IS NOT NULL")
    group = W.partitionBy("rule_name", "_start").orderBy(*order)
    kept = limited.withColumn("_rn", F.row_number().over(group)).where(F.col("_rn") <= F.lit(largest)).where("_rn <= throttle_most").drop("_rn")
    return kept.unionByName(numbered.where("throttle_seconds IS NULL OR throttle_most IS NULL")).drop("_start")


def throttle(alerts: DataFrame, rule: str, order: list[str], interval: str = "15 minutes", most: int = 3) -> DataFrame:
    """At most ``most`` alerts per rule and tumbling window, the earliest ones.

    Spark keeps only ``most`` rows per group in each task before the shuffle, so a rule that fires
    on a third of all events moves few of them.
    """
    windowed = alerts.withColumn("window_start", F.window("ts", interval)["start"])
    group = W.partitionBy(rule, "window_start").orderBy(*order)
    return windowed.withColumn("_rn", F.row_number().over(group)).where(F.col("_rn") <= most).drop("_rn")


def _bin(ts: Column, seconds: Column) -> Column:
    return F.floor(periods.epoch_us(ts) / (seconds * 1_000_000)).cast("bigint")


def escalate(opened: DataFrame, closed: DataFrame, key: str, delay_seconds: int = 1800) -> DataFrame:
    """Opened alerts without a closing event of the same key in [ts, ts + delay]."""
    stated = opened.withColumn("escalate_seconds", F.lit(delay_seconds).cast("bigint"))
    return escalate_by_rule(stated, closed, key, [delay_seconds]).drop("escalate_seconds")


def escalate_by_rule(opened: DataFrame, closed: DataFrame, key: str, delays: list[int]) -> DataFrame:
    """Opened alerts without a closing event of the same key within their own ``escalate_seconds``; those without never escalate.

    ``delays`` are the different delays that rules state. Time is cut into bins as long as the delay: a closing
    event counts if it is the bin's last one and not earlier, or the next bin's first one and in time. So closings
    are reduced to first and last per key, delay and bin before the join, all rules in one plan, and no pair of one
    key's events is ever formed.
    """
    delay = F.col("_delay")
    here = F.struct(_bin(F.col("ts"), delay).alias("_bin"), F.col("ts").alias("_last"),
                    F.lit(None).cast("timestamp_ntz").alias("_next"))
    late = F.struct((_bin(F.col("ts"), delay) - 1).alias("_bin"), F.lit(None).cast("timestamp_ntz").alias("_last"),
                    F.col("ts").alias("_next"))
    known = F.array(*[F.lit(d).cast("bigint") for d in sorted(set(delays))]).cast("array<bigint>")
    ends = (
        closed.select(key, "ts", F.explode(known).alias("_delay")).select(key, "_delay", F.inline(F.array(here, late)))
        .groupBy(key, "_delay", "_bin").agg(F.max("_last").alias("_last"), F.min("_next").alias("_next"))
    )
    stated = opened.where("escalate_seconds IS NOT NULL").withColumn("_delay", F.col("escalate_seconds").cast("bigint"))
    joined = stated.withColumn("_bin", _bin(F.col("ts"), delay)).join(ends, [key, "_delay", "_bin"], "left")
    in_time = F.timestamp_add("SECOND", F.col("_delay").cast("int"), F.col("ts")) >= F.col("_next")
    resolved = F.coalesce(F.col("_last") >= F.col("ts"), F.lit(False)) | F.coalesce(in_time, F.lit(False))
    return joined.where(~resolved).drop("_bin", "_last", "_next", "_delay")
