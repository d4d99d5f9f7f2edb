"""Time expressions. ``as_of`` is always an argument, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: str) -> Column:
    """A zone-free timestamp literal, read as UTC."""
    return F.to_timestamp_ntz(F.lit(text))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def hours_since(start: Column, as_of: Column) -> Column:
    """Age in hours; a future start counts as 0."""
    return F.greatest(F.lit(0.0), seconds_between(start, as_of) / F.lit(3600.0))


def local_date(as_of: Column, zone: str | Column) -> Column:
    """Calendar date of a UTC instant in ``zone``."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.to_date(F.from_utc_timestamp(as_of.cast("timestamp"), zone))


def plus_days(start: Column, days: int | Column) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return start + F.make_dt_interval(days)
