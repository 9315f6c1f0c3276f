"""Time expressions; all work on epoch seconds or zone-free types, so the session time zone never matters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# The first and last epoch second of years 1 and 9999, the range of a calendar date.
FIRST_SECOND = -62135596800
LAST_SECOND = 253402300799


def utc_date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def iso_utc(seconds: Column) -> Column:
    moment = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.concat(F.translate(moment.cast("string"), " ", "T"), F.lit("+00:00"))


def datetime_or_iso(text: Column, seconds: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), iso_utc(seconds))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("long")


def as_date(value: Column | dt.date | str | None) -> Column:
    """A job's reference day; the current date where the caller names none."""
    if value is None:
        return F.current_date()
    return value if isinstance(value, Column) else F.lit(value).cast("date")
