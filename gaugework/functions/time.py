"""Time helpers.

Every relative bound is worked out on the driver from an explicit ``as_of`` and
enters the plan as a TIMESTAMP_NTZ literal, so predicates stay on the bare
column and reach the Parquet scan.  Truncation goes through DATE, which keeps
TIMESTAMP_NTZ values independent of the session time zone.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "month")


def as_datetime(value: str | dt.date | dt.datetime) -> dt.datetime:
    """A naive datetime cut to whole seconds."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return value.replace(microsecond=0, tzinfo=None)


def day_start(value) -> dt.datetime:
    return as_datetime(value).replace(hour=0, minute=0, second=0)


def month_start(value) -> dt.datetime:
    return day_start(value).replace(day=1)


def add_months(value, n: int) -> dt.datetime:
    """Calendar months; a day past the end of the target month is clipped."""
    value = as_datetime(value)
    months = value.year * 12 + value.month - 1 + n
    year, month = divmod(months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return value.replace(year=year, month=month + 1, day=min(value.day, last))


def period_start(as_of, frequency: str) -> dt.datetime:
    """Start of the DAILY / WEEKLY (Monday) / MONTHLY / YEARLY period of ``as_of``."""
    day = day_start(as_of)
    if frequency == "DAILY":
        return day
    if frequency == "WEEKLY":
        return day - dt.timedelta(days=day.weekday())
    if frequency == "MONTHLY":
        return day.replace(day=1)
    if frequency == "YEARLY":
        return day.replace(month=1, day=1)
    raise ValueError(f"unknown frequency: {frequency}")


def preset(name: str, as_of, whole_day: bool = False) -> tuple[dt.datetime, dt.datetime]:
    """``last_hour``, ``last_24h``, ``last_7d`` (the default) or ``last_30d``.

    The day presets run from 00:00 to 23:59:00; ``whole_day`` extends them to 23:59:59.
    """
    now = as_datetime(as_of)
    if name == "last_hour":
        return now - dt.timedelta(hours=1), now
    if name == "last_24h":
        return now - dt.timedelta(days=1), now
    days = {"last_7d": 7, "last_30d": 30}[name]
    midnight = day_start(now)
    end = midnight.replace(hour=23, minute=59, second=59 if whole_day else 0)
    return midnight - dt.timedelta(days=days), end


def ntz(value) -> Column:
    return F.lit(as_datetime(value).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def trunc_to(col: str | Column, grain: str) -> Column:
    """Start of the hour, day or month as TIMESTAMP_NTZ."""
    c = F.col(col) if isinstance(col, str) else col
    day = F.to_date(c)
    if grain == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(c))
    if grain == "day":
        return day.cast("timestamp_ntz")
    if grain == "month":
        return F.trunc(day, "month").cast("timestamp_ntz")
    raise ValueError(f"unknown grain: {grain}")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds elapsed from ``start`` to ``end``."""
    gap = end - start
    return (
        F.extract(F.lit("DAY"), gap) * 86400
        + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
        + F.floor(F.extract(F.lit("SECOND"), gap))
    ).cast("bigint")


def utc_instant(col: str | Column) -> Column:
    """TIMESTAMP (whole seconds) of a wall-clock TIMESTAMP_NTZ read as UTC.

    Watermarks need TIMESTAMP; a plain cast would depend on the session zone.
    """
    c = F.col(col) if isinstance(col, str) else col
    seconds = (
        F.unix_date(F.to_date(c)).cast("bigint") * 86400
        + F.hour(c) * 3600
        + F.minute(c) * 60
        + F.second(c)
    )
    return F.timestamp_seconds(seconds)


def utc_wall_clock(col: str | Column) -> Column:
    """Inverse of :func:`utc_instant`: TIMESTAMP to UTC wall-clock TIMESTAMP_NTZ."""
    c = F.col(col) if isinstance(col, str) else col
    seconds = F.unix_seconds(c)
    day = F.floor(seconds / 86400)
    return F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(
        secs=(seconds - day * 86400).cast("decimal(18,6)")
    )
