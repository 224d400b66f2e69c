"""Backup folder names: ``backup_<yyyy-MM-dd>_<HH-mm-ss>_<8 hex>``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions import periods

PREFIX = "backup_"
# prefix, date, time and their underscores, then the first half of the id
NAME_HEAD = 31


def new_backup_folder(at: dt.datetime) -> str:
    """Name for a backup that starts now. Made once on the driver, so retried tasks agree on it."""
    return f"{PREFIX}{at:%Y-%m-%d_%H-%M-%S}_{uuid.uuid4().hex[:8]}"


def folder_name(ts: Column, backup_id: Column) -> Column:
    return F.concat(F.lit(PREFIX), periods.layout(ts, periods.FOLDER_LAYOUT), F.lit("_"), backup_id)


def folder_timestamp(name: Column, lenient: bool = False) -> Column:
    """Timestamp in a folder name, null when it does not parse.

    Strict needs prefix, date, time and id; lenient does without the id. Months, days and times may
    be unpadded, parts after the id are ignored.
    """
    form = rf"(?s)^{PREFIX}\d{{4}}-\d{{1,2}}-\d{{1,2}}_\d{{1,2}}-\d{{1,2}}-[0-5]?\d(_.*)" + ("?$" if lenient else "$")
    # Null for other names, so that the split is not inside a branch and is done once per row.
    fields = F.split(F.when(F.rlike(name, F.lit(form)), name), "[-_]", 8)
    year, month, day, hour, minute, second = (F.get(fields, F.lit(i)).cast("int") for i in range(1, 7))
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))


def folder_id(name: Column) -> Column:
    """Id part of a strict folder name."""
    return F.get(F.split(name, "_"), F.lit(3))


def last_part(path: Column) -> Column:
    """Text after the last underscore of a path."""
    return F.element_at(F.split(path, "_"), -1)


def trim_slash(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(trim_slash(path), "/"), -1)


def is_hidden(name: Column) -> Column:
    return F.rlike(name, F.lit("^[_.]"))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)
