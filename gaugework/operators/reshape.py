"""Stacking and turning frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name, duplicates kept; a column that a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value"
) -> DataFrame:
    """Wide to long: one row per id and value column."""
    return df.unpivot(list(ids), list(values), name, value)
