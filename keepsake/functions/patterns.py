"""Glob patterns: ``*`` any text, ``?`` one character, everything else literal, whole name matched."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(text: str) -> list[str]:
    """Comma-separated text as a list without blanks."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def parse_list_column(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != "")


def glob_regex(patterns: list[str]) -> str:
    """One regular expression for any of the patterns."""
    wild = {"*": ".*", "?": "."}

    def one(pattern: str) -> str:
        return "".join(wild.get(p, re.sub(r"([^\w\s])", r"\\\1", p)) for p in re.split(r"([*?])", pattern))

    return "(?s)^(?:" + "|".join(one(pattern) for pattern in patterns) + ")$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    """False for an empty list."""
    return F.rlike(name, F.lit(glob_regex(patterns))) if patterns else F.lit(False)


def matches_any_column(name: Column, patterns: Column) -> Column:
    """The same with an array column of patterns, one array per row."""

    def to_regex(pattern: Column) -> Column:
        literal = F.regexp_replace(pattern, r"([\\.\[\](){}+^$|])", r"\\$1")
        wild = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
        return F.concat(F.lit("(?s)^"), wild, F.lit("$"))

    return F.exists(patterns, lambda pattern: F.rlike(name, to_regex(pattern)))


def selected(name: Column, include: list[str], exclude: list[str]) -> Column:
    """Include filter (an empty list keeps all), then exclude, which wins."""
    keep = matches_any(name, include) if include else F.lit(True)
    return keep & ~matches_any(name, exclude)
