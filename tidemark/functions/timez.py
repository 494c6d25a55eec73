"""Instants, local days and the grammars for windows of time."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": None}


def parse_iso(value: Column) -> Column:
    """An ISO-8601 instant; UTC where no zone is given, null where it can't be read."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(value))


def local(ts: Column, tz: str) -> Column:
    """The wall-clock time in a zone, as a timestamp of the UTC session."""
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(local(ts, tz))


def day_bounds(day: Column, tz: str) -> Column:
    """A struct of ``start`` and ``end``, the instants of two local midnights; 23 to 25 hours apart."""
    return F.struct(F.to_utc_timestamp(day.cast("timestamp"), tz).alias("start"), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), tz).alias("end"))


def span_minutes(first: Column, last: Column, tz: str) -> Column:
    """Whole minutes of wall-clock time between two instants."""
    return F.floor((F.unix_micros(local(last, tz)) - F.unix_micros(local(first, tz))) / F.lit(60_000_000)).cast("int")


def parse_since(value: str | None, as_of: dt.datetime) -> dt.datetime | None:
    """``7d``, ``14h`` or ``2w`` before ``as_of``; ``all`` and None have no bound."""
    if value is None or value == "all":
        return None
    m = re.fullmatch(r"(\d+)([hdw])", value)
    if not m:
        raise ValueError(f"expected e.g. 7d, 14h, 2w or all, got {value!r}")
    return as_of - dt.timedelta(**{{"h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])})


def window_days(name: str) -> int | None:
    if name not in WINDOWS:
        raise ValueError(f"expected one of {', '.join(WINDOWS)}, got {name!r}")
    return WINDOWS[name]
