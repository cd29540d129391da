"""Period, lookback and facet predicates.

All of them compare the bare column with literals, so Parquet row groups can be
skipped.  Logs laid out by ``write_usage_log`` also carry a partition column with the
date of their time column; filters on that column then add the matching date range and
whole directories are pruned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import add_months, as_datetime, asc, day_start, ntz


def partition_column(ts_col: str) -> str:
    """Named after its source, so that a filter on another time column prunes nothing."""
    return f"{ts_col}_date"


def _date_range(df: DataFrame, col: str, start, end) -> Column:
    date_col = partition_column(col)
    if date_col not in df.columns:
        return F.lit(True)
    return F.col(date_col).between(F.lit(as_datetime(start).date()), F.lit(as_datetime(end).date()))


def since(df: DataFrame, col: str, start, as_of) -> DataFrame:
    """``start <= col <= as_of``: what was known at ``as_of``, so a result can be repeated later."""
    return period_filter(df, col, start, as_of)


def period_filter(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive range, both bounds cut to whole seconds."""
    return df.where(F.col(col).between(ntz(start), ntz(end)) & _date_range(df, col, start, end))


def date_period_filter(df: DataFrame, col: str, start, end) -> DataFrame:
    """As :func:`period_filter` on a DATE column: both end days are whole."""
    first, last = as_datetime(start).date(), as_datetime(end).date()
    return df.where(F.col(col).between(F.lit(first), F.lit(last)))


def lookback_start(as_of, n: int, unit: str, from_midnight: bool = False) -> dt.datetime:
    base = day_start(as_of) if from_midnight else as_datetime(as_of)
    if unit == "hour":
        return base - dt.timedelta(hours=n)
    if unit == "day":
        return base - dt.timedelta(days=n)
    if unit == "month":
        return add_months(base, -n)
    raise ValueError(f"unknown unit: {unit}")


def lookback(
    df: DataFrame, col: str, n: int, unit: str, as_of, from_midnight: bool = False
) -> DataFrame:
    """``as_of - n units <= col <= as_of``; ``from_midnight`` counts back from the day's start."""
    start = lookback_start(as_of, n, unit, from_midnight)
    if dict(df.dtypes)[col] == "date":
        # A DATE equals its midnight: a bound within a day starts with the next date.
        first = start.date() if start == day_start(start) else start.date() + dt.timedelta(days=1)
        return df.where(F.col(col).between(F.lit(first), F.lit(as_datetime(as_of).date())))
    return since(df, col, start, as_of)


def in_list(df: DataFrame, col: str, values: Iterable[str | None]) -> DataFrame:
    """Membership; a None in the list stands for ``''``; an empty list does not filter."""
    wanted = ["" if v is None else str(v) for v in values or ()]
    return df.where(F.col(col).isin(wanted)) if wanted else df


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """AND of the equalities that are set (not None)."""
    for col, value in equals.items():
        if value is not None:
            df = df.where(F.col(col) == F.lit(value))
    return df


def facet_filter(df: DataFrame, **facets: Sequence[str]) -> DataFrame:
    """Rows whose value is selected in every facet; an empty selection keeps nothing."""
    for col, selected in facets.items():
        df = df.where(F.col(col).isin(list(selected)))
    return df


def active_only(df: DataFrame, col: str = "deleted_on") -> DataFrame:
    return df.where(F.col(col).isNull())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(asc(col))


def preview_text(col: str, n: int) -> Column:
    """The first ``n`` characters for display."""
    return F.substring(F.col(col), 1, n)
