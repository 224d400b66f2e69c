"""Ages, calendar keys, durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Age buckets, upper bounds inclusive.
AGE_BUCKETS = [("0-7 days", 7), ("8-30 days", 30), ("31-90 days", 90), ("91-365 days", 365), ("365+ days", None)]

# Time layouts.
LOG_LAYOUT = "yyyy-MM-dd HH:mm:ss"
FOLDER_LAYOUT = "yyyy-MM-dd_HH-mm-ss"
REPORT_LAYOUT = "yyyyMMdd_HHmmss"


def as_of_column(as_of: dt.datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free time.

    Built from its fields: differences of timestamps are taken in the session's time zone, in which
    some local times do not exist.
    """
    whole = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def event_time(us: Column) -> Column:
    """Instant for a watermark, which takes no zone-free times."""
    return F.timestamp_micros(us)


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_second(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / F.lit(1_000_000)).cast("bigint")


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole 24-hour periods elapsed, rounded down, negative for the future."""
    return F.floor((epoch_us(as_of) - epoch_us(ts)) / F.lit(DAY_US)).cast("bigint")


def layout(ts: Column, form: str) -> Column:
    """Text in one of the fixed layouts."""
    text = F.substring(ts.cast("string"), 1, 19)
    if form == LOG_LAYOUT:
        return text
    if form == FOLDER_LAYOUT:
        return F.translate(text, " :", "_-")
    if form == REPORT_LAYOUT:
        return F.translate(text, " -:", "_")
    raise ValueError(f"unknown layout {form!r}")


def day_key(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def month_key(ts: Column) -> Column:
    return F.substring(day_key(ts), 1, 7)


def week_key(ts: Column) -> Column:
    """Year and week with weeks starting on Sunday; days before the first Sunday are week 00."""
    week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int")
    return F.format_string("%04d-W%02d", F.year(ts), week)


def age_bucket(age: Column) -> Column:
    label = F.lit(AGE_BUCKETS[-1][0])
    for name, upper in reversed(AGE_BUCKETS[:-1]):
        label = F.when(age <= upper, F.lit(name)).otherwise(label)
    return label


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two second-truncated times."""
    return (epoch_second(end) - epoch_second(start)).cast("double")


def iso_seconds(text: Column) -> Column:
    """Seconds in an ISO-8601 time duration such as PT1H30M or PT24H; null if it is not one."""
    form = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, form, group).try_cast("bigint"), F.lit(0).cast("bigint"))

    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(F.rlike(text, F.lit(form)), total)


def archive_due(age: Column, after_days: int = 30) -> Column:
    return age > after_days
