"""Exact continuous percentiles without gathering a group in one task.

Spark's ``percentile`` merges a value -> count map of the whole group in a single
task.  Here the counts stay spread by (key, value):

1. count per (key, value), combined map-side: a hot key or value costs no more
   than its distinct values;
2. a histogram per key over value buckets gives the running count, hence the buckets that
   hold the wanted ranks;
3. only the values of those buckets go on.  A hit bucket is split by its own least and greatest value into ``PARTS``
   equal parts, and only the values of the parts that hold the ranks are ranked.

Buckets are 1/4096 wide on a log scale, so the doubles in one lie in at most two octaves, fewer than 2^42 of
them.  A part holds fewer than 2^22: that many different values are ranked together at most, whatever the input is.  Long
integers beyond 2^53 are as many more as share a double.

The counts are used twice, but they come from one shuffle: Spark reuses the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_E = 4096
# Logarithms of positive doubles are above -745.2, so this makes them positive.
_LIFT = 746
PARTS = 1 << 20

# Infinite values sit in the end buckets; no finite double reaches them.  NaN is greater than all, as Spark sorts it.
_END = 1 << 23


def _bucket(value: Column) -> Column:
    """Never decreases with the value, which is all the method needs."""
    v = value.cast("double")
    scaled = F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + _LIFT) * _PER_E)
    held = F.floor(F.greatest(F.least(scaled, F.lit(float(_END))), F.lit(float(-_END)))).cast("int")
    return F.when(F.isnan(v), _END + 1).otherwise(held)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, freq``: the shared first step; NULL values keep their own row."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))


def exact_percentiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: dict[str, float],
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles (``percentile_cont``) from :func:`value_counts`.

    ``percentiles`` maps output column -> fraction.  ``sums`` are further outputs, each
    the sum over the counts of an expression of ``value`` and ``freq``; they ride along
    with the histogram.  One row per key combination, one row in all without keys.
    """
    keys, sums = list(keys), dict(sums or {})
    bucketed = counts.withColumn("bucket", _bucket(F.col(value)))

    located = _located(bucketed, keys, value, sums)
    buckets = located.where(_holds_rank(percentiles)).drop("in_bucket", "upto")
    inside = _within(buckets, bucketed, [*keys, "bucket"], value)
    inside = _split(inside, keys, value, percentiles, list(sums))

    within = (
        Window.partitionBy(*keys, "before")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = inside.withColumn("past", F.col("before") + F.sum("freq").over(within)).withColumn(
        "first", F.col("past") - F.col("freq")
    )

    def at(r: Column) -> Column:
        hit = (r >= F.col("first")) & (r < F.col("past"))
        return F.max(F.when(hit, F.col(value))).cast("double")

    picks = []
    for name, p in percentiles.items():
        low, high = _ranks(p)
        picks += [at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high")]
    picked = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), *picks, *[F.max(name).alias(name) for name in sums]
    )
    out = []
    for name, p in percentiles.items():
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        part = _position(p) - F.floor(_position(p))
        # Equal neighbours need no interpolation, which infinite ones would not survive.
        out.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return picked.select(*keys, *out, *sums)


def _position(fraction: float) -> Column:
    return F.lit(float(fraction)) * (F.col("n") - 1)


def _ranks(fraction: float) -> tuple[Column, Column]:
    return F.floor(_position(fraction)), F.ceil(_position(fraction))


def _holds_rank(percentiles: dict[str, float]) -> Column:
    holds = F.col("n") == 0  # only NULL values: keep the key
    for p in percentiles.values():
        for r in _ranks(p):
            holds = holds | ((r >= F.col("before")) & (r < F.col("upto")))
    return holds


def _located(bucketed: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """The histogram: rows before each bucket, rows of the key, its least and greatest value; NULL values in a NULL bucket."""
    histogram = bucketed.groupBy(*keys, "bucket").agg(
        F.sum(F.when(F.col(value).isNotNull(), F.col("freq")).otherwise(0)).alias("in_bucket"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        *[F.sum(expr).alias(name) for name, expr in sums.items()],
    )
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.select(
        *keys,
        "bucket",
        F.sum("in_bucket").over(running).alias("upto"),
        "in_bucket",
        "least",
        "most",
        F.sum("in_bucket").over(whole).alias("n"),
        *[F.sum(name).over(whole).alias(name) for name in sums],
    ).withColumn("before", F.col("upto") - F.col("in_bucket"))


def _within(buckets: DataFrame, rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The values of ``rows`` in ``buckets``, with the columns of those."""
    # NULL keys are groups of their own, hence the null-safe match.
    same = F.lit(True)
    for key in by:
        same = same & F.col(f"b.{key}").eqNullSafe(F.col(f"v.{key}"))
    kept = [c for c in buckets.columns if c != value]
    return buckets.alias("b").join(rows.alias("v"), same).select(
        *[F.col(f"b.{c}") for c in kept], F.col(f"v.{value}").alias(value), F.col("v.freq").alias("freq")
    )


def _split(inside: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], sums: list[str]) -> DataFrame:
    """The values of the parts that hold a rank, of every bucket in ``inside``."""
    v, least, most = (F.col(c).cast("double") for c in (value, "least", "most"))
    # Halves, as the difference of two doubles may not be one.
    place = F.floor((v / 2 - least / 2) / (most / 2 - least / 2) * PARTS)
    part = F.when(least < most, F.least(place, F.lit(PARTS - 1))).otherwise(0).cast("int")
    # A bucket is named by its key and the rows before it.
    placed = inside.withColumn("part", part).withColumnRenamed("before", "start")
    parts = placed.groupBy(*keys, "start", "part").agg(
        F.sum(F.when(F.col(value).isNotNull(), F.col("freq")).otherwise(0)).alias("in_part"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.max("n").alias("n"),
        *[F.max(name).alias(name) for name in sums],
    )
    running = Window.partitionBy(*keys, "start").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("upto", F.col("start") + F.sum("in_part").over(running))
    parts = parts.withColumn("before", F.col("upto") - F.col("in_part")).where(_holds_rank(percentiles))
    found = _within(parts.drop("in_part", "upto"), placed, [*keys, "start", "part"], value)
    return found.drop("start", "part")
