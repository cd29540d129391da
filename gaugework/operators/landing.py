"""Landing tables: technical columns, versions of a business key, current rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import ntz

LOADED_AT, SOURCE_FILE, ROW_HASH, IS_CURRENT = "_loaded_at", "_source_file", "_row_hash", "_is_current"
TECHNICAL = (LOADED_AT, SOURCE_FILE, ROW_HASH, IS_CURRENT)

# What makes one version newer than another.
_ORDER = (LOADED_AT, SOURCE_FILE, ROW_HASH)


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TECHNICAL]


# NULL fields are kept apart from empty ones, and times keep their microseconds.
_HASHED_AS = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_hash(cols: Sequence[str]) -> Column:
    """64 hex digits over the whole business row."""
    return F.sha2(F.to_json(F.struct(*cols), _HASHED_AS), 256)


def load_time(as_of) -> Column:
    """The given load time, or the clock when there is none."""
    return F.localtimestamp() if as_of is None else ntz(as_of)


def landing_enrich(df: DataFrame, as_of=None, source_file: Column | None = None) -> DataFrame:
    """Add ``_loaded_at``, ``_source_file``, ``_row_hash`` and ``_is_current`` (TRUE)."""
    cols = business_columns(df)
    if source_file is None:
        source_file = F.col(SOURCE_FILE) if SOURCE_FILE in df.columns else F.lit(None).cast("string")
    return df.select(
        *cols,
        load_time(as_of).alias(LOADED_AT),
        source_file.alias(SOURCE_FILE),
        row_hash(cols).alias(ROW_HASH),
        F.lit(True).alias(IS_CURRENT),
    )


def _newest_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # max() of a struct combines map-side: a key that holds a third of the rows sends one
    # row per task, where a ranking window would sort them all in one.
    return df.groupBy(*keys).agg(F.max(F.struct(*_ORDER)).alias("_newest"))


def _match(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return cond


def _without_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Rows with the same hash have the same content, so whole rows can be compared: grouping
    # without aggregates runs in a hash table, where first() of text columns needs a sort.
    if any(kind.startswith(("map", "variant")) for _, kind in df.dtypes):
        return df.dropDuplicates([*keys, *_ORDER])
    return df.distinct()


def mark_current(df: DataFrame, keys: Sequence[str], distinct_rows: bool = False) -> DataFrame:
    """Exactly the newest row of every business key is current; no version is lost.

    Newest is by load time, then file, then hash.  Copies of one row within one load are
    a single version and are kept once; say ``distinct_rows`` when there are none, which
    saves the shuffle that looks for them.
    """
    cols = [c for c in df.columns if c != IS_CURRENT]
    versions = df.select(*cols)
    if not distinct_rows:
        versions = _without_copies(versions, keys)
    newest = _newest_per_key(df, keys)
    # The join to one row per key may be skewed on the log side; adaptive execution splits it.
    joined = versions.alias("l").join(newest.alias("r"), _match(keys), "left")
    this = F.struct(*[F.col(f"l.{c}") for c in _ORDER])
    return joined.select(
        *[F.col(f"l.{c}") for c in cols], this.eqNullSafe(F.col("r._newest")).alias(IS_CURRENT)
    ).select(*df.columns)


def current_rows(df: DataFrame) -> DataFrame:
    """Rows to present."""
    return df.where(F.col(IS_CURRENT))


def latest_versions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The current rows straight from the versions: one aggregation, no flag to maintain."""
    rest = [c for c in df.columns if c not in keys and c not in _ORDER]
    order = F.struct(*_ORDER)
    aggregates = [F.max(order).alias("o")]
    if rest:
        # Equal order means equal hash, hence equal content: any of them will do.
        aggregates.append(F.max_by(F.struct(*rest), order).alias("r"))
    newest = df.groupBy(*keys).agg(*aggregates)

    def source(c: str) -> Column:
        return F.col(c if c in keys else f"o.{c}" if c in _ORDER else f"r.{c}")

    return newest.select(*[source(c).alias(c) for c in df.columns])


def unchanged_removed(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` that are not already the current version of their key.

    The stored keys are shuffled, never broadcast: a broadcast goes through the driver, once for every batch of a stream.
    """
    known = latest_versions(stored.select(*keys, *_ORDER), keys).hint("merge")
    return batch.alias("l").join(
        known.alias("r"), _match([*keys, ROW_HASH]), "left_anti"
    )


def append_versions(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored versions plus the changed rows of a batch, with flags brought up to date."""
    fresh = unchanged_removed(batch, stored, keys)
    return mark_current(stored.unionByName(fresh), keys)


def load_log(
    loaded: DataFrame, as_of=None, corrupt: str = "_corrupt_record", files: DataFrame | None = None
) -> DataFrame:
    """Outcome per file: rows parsed, rows loaded, errors, status and time.

    ``files`` (``file_name``) adds a row for files that gave no rows.

    ``loaded`` has to be persisted or written first: Spark does not count the rows that
    fail to parse straight from text files.
    """
    bad = F.count_if(F.col(corrupt).isNotNull()) if corrupt in loaded.columns else F.lit(0)
    per_file = loaded.groupBy(F.col(SOURCE_FILE).alias("file_name")).agg(
        F.count(F.lit(1)).alias("row_parsed"), bad.cast("bigint").alias("error_count")
    )
    if files is not None:
        empty = files.select("file_name").distinct().join(per_file, "file_name", "left_anti")
        nothing = F.lit(0).cast("bigint")
        per_file = per_file.unionByName(
            empty.select("file_name", nothing.alias("row_parsed"), nothing.alias("error_count"))
        )
    good = F.col("row_parsed") - F.col("error_count")
    return per_file.select(
        "file_name",
        good.alias("row_count"),
        "row_parsed",
        "error_count",
        F.when(F.col("error_count") == 0, "LOADED")
        .when(good == 0, "LOAD_FAILED")
        .otherwise("PARTIAL")
        .alias("status"),
        load_time(as_of).alias("last_load_time"),
    )
