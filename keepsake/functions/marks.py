"""High-water marks as text that means the same in every session.

A mark is ``type=value``. Instants are microseconds since 1970 and dates days, so neither the session's
time zone nor a clock that shows an hour twice can move them; all other values are exact as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FAMILIES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "fraction", "double": "fraction",
             "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz"}


def _family(name: str) -> str | None:
    return "decimal" if name.startswith("decimal(") else _FAMILIES.get(name)


def mark_text(value: Column, kind: T.DataType) -> Column:
    """The mark of a value, null for null. Raises for types whose values cannot be a mark."""
    name = kind.simpleString()
    if isinstance(kind, (T.CharType, T.VarcharType)):
        name = "string"
    if _family(name) is None:
        raise ValueError(f"a column of type {name} cannot be a high-water mark")
    plain = {"timestamp": F.unix_micros, "date": F.unix_date, "binary": F.hex}.get(name, lambda x: x)(value)
    return F.concat(F.lit(f"{name}="), plain.cast("string"))


def mark_value(mark: str) -> Column:
    """The value a mark stands for, of the type it was taken from; a constant that filters can push down."""
    name, value = mark.split("=", 1)
    if name == "timestamp":
        return F.timestamp_micros(F.lit(int(value)))
    if name == "date":
        return F.date_from_unix_date(F.lit(int(value)))
    if name == "binary":
        return F.unhex(F.lit(value))
    return F.lit(value).cast(name)


def mark_fits(mark: str, kind: T.DataType) -> bool:
    """Whether a stored mark can be compared with a column; marks of older backups name no type and cannot."""
    name, found, _ = mark.partition("=")
    return bool(found) and _family(name) is not None and _family(name) == _family("string" if isinstance(kind, (T.CharType, T.VarcharType)) else kind.simpleString())
