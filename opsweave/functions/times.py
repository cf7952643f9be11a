"""Instants, days and clock times in UTC, whatever the time zone of the session."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Instant = str | dt.datetime
DAY_MICROS = 86_400_000_000


def at(instant: Instant) -> Column:
    """A point in time; one without an offset is UTC."""
    when = dt.datetime.fromisoformat(instant) if isinstance(instant, str) else instant
    if when.tzinfo is None:
        when = when.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(round((when - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))))


def utc_day(ts: Column) -> Column:
    micros = F.unix_micros(ts)
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int"))


def _two(number: Column) -> Column:
    return F.lpad(number.cast("long").cast("string"), 2, "0")


def utc_clock(ts: Column) -> Column:
    """HH:mm."""
    minutes = F.floor(F.pmod(F.unix_micros(ts), F.lit(DAY_MICROS)) / 60_000_000)
    return F.concat(_two(F.floor(minutes / 60)), F.lit(":"), _two(minutes % 60))


def utc_stamp(ts: Column) -> Column:
    """ISO 8601 with microseconds and offset."""
    micros = F.pmod(F.unix_micros(ts), F.lit(DAY_MICROS))
    seconds = F.floor(micros / 1_000_000)
    return F.concat(utc_day(ts).cast("string"), F.lit("T"), utc_clock(ts), F.lit(":"), _two(seconds % 60), F.lit("."),
                    F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("+00:00"))
