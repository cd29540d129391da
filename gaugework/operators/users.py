"""Consumption by person and edits of the quota configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions import asc, desc, ordered, top_k
from gaugework.operators.filters import in_list, lookback

MINUTE_MS = 60_000.0


def _elapsed_ms(qh: DataFrame, as_of, days: int, warehouses: Sequence[str] | None) -> DataFrame:
    """Elapsed ms per (warehouse, user): all that the operators here shuffle again."""
    rows = in_list(lookback(qh, "start_time", days, "day", as_of), "warehouse_name", warehouses or ())
    return rows.groupBy("warehouse_name", "user_name").agg(F.sum("total_elapsed_time").alias("ms"))


def _top_users(base: DataFrame, k: int, least_ms: int) -> DataFrame:
    """The ``k`` users with most time, from ``least_ms`` on; a NULL user can take a place."""
    totals = base.groupBy("user_name").agg(F.sum("ms").alias("user_ms"))
    enough = totals.where(F.col("user_ms") >= least_ms)
    ranked = top_k(enough, k, desc("user_ms"), asc("user_name"))
    return ranked.select(F.col("user_name").alias("top_user"))


def _only_top(base: DataFrame, top: DataFrame, rest: str | None) -> DataFrame:
    """Time per warehouse and top user, everyone else as ``rest``: ``k + 1`` rows a warehouse.

    An outer join, because an inner or semi join would push ``user_name IS NOT NULL`` down
    to this use of the aggregated log; its shuffle could not be shared with the ranking.
    """
    # k rows at most, so the broadcast is bounded.
    joined = base.join(F.broadcast(top), F.col("user_name") == F.col("top_user"), "left")
    label = F.coalesce("top_user", F.lit(rest).cast("string"))
    return joined.groupBy("warehouse_name", label.alias("user_name")).agg(F.sum("ms").alias("ms"))


def _whole_ms(counted: Column) -> Column:
    """Total of the row's warehouse over the counted rows; NULL for rows without a warehouse,
    so that they fail any bound.  (A plain filter would be pushed down as well.)"""
    named = F.when(F.col("warehouse_name").isNotNull() & counted, F.col("ms"))
    return F.sum(named).over(Window.partitionBy("warehouse_name"))


def user_share_by_warehouse(
    qh: DataFrame, as_of, days: int = 30, k: int = 8, warehouses: Sequence[str] | None = None
) -> DataFrame:
    """Share of each warehouse's time: the top ``k`` users overall by name, the rest as Other.

    A NULL user can rank but is shown under Other.  The window sees at most ``k + 1``
    rows per warehouse.
    """
    base = _elapsed_ms(qh, as_of, days, warehouses)
    labelled = _only_top(base, _top_users(base, k, 0), "Other").withColumn("whole_ms", _whole_ms(F.lit(True)))
    share = F.try_divide(F.col("ms").cast("double"), F.col("whole_ms").cast("double"))
    out = labelled.where(F.col("whole_ms") > 0).select(
        "warehouse_name",
        "user_name",
        (F.col("ms") / F.lit(MINUTE_MS)).alias("total_min"),
        share.alias("share"),
        (share * 100).alias("share_pct"),
    )
    return ordered(out, asc("warehouse_name"), desc("share"), asc("user_name"))


def warehouse_order(shares: DataFrame) -> DataFrame:
    """Warehouses of :func:`user_share_by_warehouse` by total minutes, largest first."""
    totals = shares.groupBy("warehouse_name").agg(F.sum("total_min").alias("total_min"))
    return ordered(totals, desc("total_min"), asc("warehouse_name"))


def top_users_by_time(
    qh: DataFrame, as_of, days: int = 30, k: int = 10, warehouses: Sequence[str] | None = None
) -> DataFrame:
    rows = in_list(lookback(qh, "start_time", days, "day", as_of), "warehouse_name", warehouses or ())
    by_user = (
        rows.groupBy("user_name")
        .agg(F.sum("total_elapsed_time").alias("ms"))
        .where(F.col("ms") > 0)
        .select("user_name", (F.col("ms") / F.lit(MINUTE_MS)).alias("total_min"))
    )
    return top_k(by_user, k, desc("total_min"), asc("user_name"))


def user_warehouse_matrix(
    qh: DataFrame,
    as_of,
    users: Sequence[str] | DataFrame,
    days: int = 30,
    min_minutes: float = 20,
    warehouses: Sequence[str] | None = None,
) -> DataFrame:
    """Minutes per warehouse and user for the given users.

    ``users`` is a list of names, which filters the scan, or a frame with ``user_name``,
    which is matched after the aggregation.  Kept are the warehouses where those users
    together exceed ``min_minutes``.
    """
    if isinstance(users, DataFrame):
        base = _elapsed_ms(qh, as_of, days, warehouses).join(
            users.select("user_name"), "user_name", "left_semi"
        )
    else:
        base = _elapsed_ms(qh.where(F.col("user_name").isin(list(users))), as_of, days, warehouses)
    return _matrix(base, min_minutes)


def top_user_matrix(
    qh: DataFrame,
    as_of,
    days: int = 30,
    k: int = 10,
    min_minutes: float = 20,
    warehouses: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`user_warehouse_matrix` for the users of :func:`top_users_by_time`.

    Ranking and matrix use the same aggregation, so the log is read and shuffled once.
    """
    base = _elapsed_ms(qh, as_of, days, warehouses)
    return _matrix(_only_top(base, _top_users(base, k, 1), None), min_minutes)


def _matrix(per_user: DataFrame, min_minutes: float) -> DataFrame:
    known = F.col("user_name").isNotNull()
    out = (
        per_user.withColumn("whole_ms", _whole_ms(known))
        .where((F.col("whole_ms") > min_minutes * MINUTE_MS) & known)
        .select("warehouse_name", "user_name", (F.col("ms") / F.lit(MINUTE_MS)).alias("total_min"))
    )
    return ordered(out, asc("warehouse_name"), asc("user_name"))


def user_warehouse_pivot(matrix: DataFrame, users: Sequence[str]) -> DataFrame:
    """One column per listed user, 0 where the user did not use the warehouse."""
    return matrix.groupBy("warehouse_name").pivot("user_name", list(users)).agg(F.sum("total_min")).na.fill(0.0)


# Columns an edit may change, matched by warehouse.
EDITABLE = (
    "credit_limit",
    "auto_suspend_at_100",
    "alert_threshold_70",
    "alert_threshold_85",
    "alert_threshold_95",
    "alert_emails",
    "is_active",
    "frequency",
)


def config_changes(edited: DataFrame, stored: DataFrame) -> DataFrame:
    """Edited rows that differ from every stored row, NULLs comparing equal."""
    same = F.lit(True)
    e, s = edited.alias("e"), stored.alias("s")
    for col in edited.columns:
        same = same & F.col(f"e.{col}").eqNullSafe(F.col(f"s.{col}"))
    return e.join(s, same, "left_anti")


def accepted_changes(changes: DataFrame) -> DataFrame:
    """Changes that may be saved: a negative limit is refused, the limit is a whole number."""
    return changes.where(F.col("credit_limit") >= 0).withColumn(
        "credit_limit", F.col("credit_limit").cast("bigint").cast(changes.schema["credit_limit"].dataType)
    )
