"""Storage, file loads, tables and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import asc, desc, ordered, round_to, top_k
from gaugework.operators.filters import active_only, date_period_filter, lookback, period_filter

GIB = 1024.0**3
TIB = 1024.0**4

# Names of the storage kinds as shown.
_KINDS = (("Tables", "table_tb"), ("Stages", "stage_tb"), ("Fail-safe", "failsafe_tb"))


def storage_by_day(st: DataFrame, start=None, end=None, as_of=None) -> DataFrame:
    """Daily averages in TB, for a period (whole days) or the 30 days before ``as_of``."""
    if as_of is not None:
        rows = lookback(st, "usage_date", 30, "day", as_of, from_midnight=True)
    else:
        rows = date_period_filter(st, "usage_date", start, end)

    def tb(expr: Column) -> Column:
        return round_to(F.avg(expr) / F.lit(TIB), 4)

    total = F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")
    out = rows.groupBy(F.col("usage_date").alias("usage_day")).agg(
        tb(total).alias("total_tb"),
        tb(F.col("storage_bytes")).alias("storage_tb"),
        tb(F.col("stage_bytes")).alias("stage_tb"),
        tb(F.col("failsafe_bytes")).alias("failsafe_tb"),
    )
    return ordered(out, asc("usage_day"))


def storage_avg_7d(st: DataFrame, as_of) -> DataFrame:
    """Average TB per kind over 7 days; the total adds the parts that are present."""
    row = lookback(st, "usage_date", 7, "day", as_of, from_midnight=True).agg(
        round_to(F.avg("storage_bytes") / F.lit(TIB), 3).alias("table_tb"),
        round_to(F.avg("stage_bytes") / F.lit(TIB), 3).alias("stage_tb"),
        round_to(F.avg("failsafe_bytes") / F.lit(TIB), 3).alias("failsafe_tb"),
    )
    parts = [F.coalesce(F.col(col), F.lit(0.0)) for _, col in _KINDS]
    return row.withColumn("total_tb", parts[0] + parts[1] + parts[2])


def storage_split(st: DataFrame, as_of) -> DataFrame:
    """Three rows (type, tb); a missing part counts as 0."""
    row = storage_avg_7d(st, as_of)
    wide = row.select(*[F.coalesce(F.col(col), F.lit(0.0)).alias(kind) for kind, col in _KINDS])
    return wide.unpivot([], [kind for kind, _ in _KINDS], "type", "tb")


def storage_growth(st: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Total TB on the first and last day of the window and the change between them."""
    total = F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")
    daily = (
        lookback(st, "usage_date", days, "day", as_of, from_midnight=True)
        .groupBy("usage_date")
        .agg(round_to(F.avg(total) / F.lit(TIB), 4).alias("tb"))
    )
    row = daily.agg(
        F.min("usage_date").alias("first_day"),
        F.max("usage_date").alias("last_day"),
        F.min_by("tb", "usage_date").alias("first_tb"),
        F.max_by("tb", "usage_date").alias("last_tb"),
    )
    change = F.col("last_tb") - F.col("first_tb")
    return row.withColumn("growth_tb", round_to(change, 4)).withColumn(
        "growth_pct", round_to(F.try_divide(change * 100, F.col("first_tb")), 2)
    )


LOAD_COLUMNS = (
    "pipe_name",
    "file_name",
    "stage_location",
    "last_load_time",
    "row_count",
    "row_parsed",
    "error_count",
    "status",
)


def load_history(copies: DataFrame, start, end, k: int | None = 200) -> DataFrame:
    rows = period_filter(copies, "last_load_time", start, end).select(*LOAD_COLUMNS)
    return top_k(rows, k, desc("last_load_time"))


def load_kpis(copies: DataFrame, start, end, k: int | None = None) -> DataFrame:
    """Totals of the period; ``k`` restricts them to the loads that :func:`load_history` lists."""
    return load_history(copies, start, end, k).agg(
        F.count(F.lit(1)).alias("loads"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"),
    )


def largest_tables(tables: DataFrame, k: int | None = 50) -> DataFrame:
    rows = (
        active_only(tables, "deleted")
        .where((F.col("bytes") > 0) & (F.col("table_type") == "BASE TABLE"))
        .select(
            F.col("table_catalog").alias("database_name"),
            F.col("table_schema").alias("schema_name"),
            "table_name",
            "row_count",
            "bytes",
            "created",
            "last_altered",
        )
    )
    size = round_to(F.col("bytes") / F.lit(GIB), 4).alias("size_gb")
    return top_k(rows, k, desc("bytes")).select(
        "database_name", "schema_name", "table_name", "row_count", size, "created", "last_altered"
    )


def largest_tables_kpis(tables: DataFrame, k: int | None = None) -> DataFrame:
    return largest_tables(tables, k).agg(
        F.coalesce(F.sum("size_gb"), F.lit(0.0)).alias("total_gb"),
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
    )


def stage_inventory(stages: DataFrame, k: int | None = 100) -> DataFrame:
    rows = active_only(stages, "deleted").select(
        F.col("stage_catalog").alias("database_name"),
        F.col("stage_schema").alias("schema_name"),
        "stage_name",
        "stage_type",
        "stage_url",
        "created",
        "last_altered",
        "stage_owner",
    )
    return top_k(rows, k, asc("stage_name"))


def stage_type_counts(stages: DataFrame, k: int | None = None) -> DataFrame:
    return (
        stage_inventory(stages, k)
        .where(F.col("stage_type").isNotNull())
        .groupBy("stage_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def stage_kpis(stages: DataFrame, k: int | None = None) -> DataFrame:
    kind = F.lower("stage_type")
    return stage_inventory(stages, k).agg(
        F.count(F.lit(1)).alias("stages"),
        F.count_if(kind.contains("internal")).alias("internal"),
        F.count_if(kind.contains("external")).alias("external"),
    )


def stage_storage_recent(ss: DataFrame, as_of, k: int = 50) -> DataFrame:
    rows = lookback(ss, "usage_date", 1, "day", as_of, from_midnight=True)
    return top_k(rows, k, desc("average_stage_bytes"))
