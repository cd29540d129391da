"""Consecutive numbers for the rows of a distributed frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` keeps the place within a partition in its low 33 bits.
_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, path: str, name: str, start: int | Column = 0, order: tuple[Column | str, ...] = ()) -> DataFrame:
    """``df`` plus ``name``: ``start``, ``start + 1``, ... without gaps, in ``order`` if given.

    Every task numbers its own rows and the rows are written to ``path`` with these places, so a task that runs again
    cannot hand out other ones.  The rows per partition are then added up to offsets: one small row per partition of the
    write, which is also what is broadcast.  No row passes through a single task; ``order`` sorts by ranges.
    """
    part, place = f"_{name}_part", f"_{name}_place"
    rows = df.orderBy(*order) if order else df
    placed = rows.withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}
    )
    placed.write.parquet(path)
    kept = df.sparkSession.read.schema(placed.schema).parquet(path)
    counts = kept.groupBy(part).agg(F.count("*").alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).alias("_before")
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        kept.join(F.broadcast(counts.select(part, before)), part)
        .withColumn(name, (first + F.col("_before") + F.col(place)).cast("bigint"))
        .drop(part, place, "_before")
    )
