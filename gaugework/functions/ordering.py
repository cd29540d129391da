"""Sorting with explicit NULL placement and total tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNORDERABLE = ("map", "variant")


def asc(name: str, nulls: str = "last") -> Column:
    c = F.col(name)
    return c.asc_nulls_last() if nulls == "last" else c.asc_nulls_first()


def desc(name: str, nulls: str = "last") -> Column:
    c = F.col(name)
    return c.desc_nulls_last() if nulls == "last" else c.desc_nulls_first()


def ordered(df: DataFrame, *keys: Column) -> DataFrame:
    return df.orderBy(*keys)


def top_k(df: DataFrame, k: int | None, *keys: Column) -> DataFrame:
    """First ``k`` rows by ``keys``; ties are broken by every column in turn.  None takes all, unordered.

    Plans as TakeOrderedAndProject: each task keeps its own best ``k`` rows and
    only those travel, so the input is never sorted as a whole.
    """
    if k is None:
        return df
    rest = [
        F.col(f"`{name}`").asc_nulls_last()
        for name, kind in df.dtypes
        if not kind.startswith(_UNORDERABLE)
    ]
    return df.orderBy(*keys, *rest).limit(k)
