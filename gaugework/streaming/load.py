"""Continuous load of new files and incremental refresh of presented tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugework.operators.landing import (
    current_rows,
    landing_enrich,
    latest_versions,
    load_log,
    unchanged_removed,
)
from gaugework.sources.files import (
    CORRUPT,
    SOURCE_FILE,
    check_format,
    reader_options,
    with_corrupt_column,
)
from gaugework.sources.tables import VersionedTable
from gaugework.streaming.batches import BATCH, STREAM, read_batches, stream_id, trigger, write_batch


def stream_load(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    out: str,
    log_out: str,
    checkpoint: str,
    as_of=None,
    cadence: str | None = None,
    options: dict[str, str] | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Append the rows of new files to a landing table, each file once.

    ``out`` gets the rows with their technical columns, ``log_out`` one row per file.
    Rows that do not parse are counted there and not landed.  ``max_files`` bounds a
    micro-batch.
    """
    fmt = check_format(fmt)
    reader = (
        spark.readStream.format(fmt)
        .options(**reader_options(fmt, options))
        .schema(with_corrupt_column(fmt, schema))
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    source = reader.load(path).withColumn(SOURCE_FILE, F.col("_metadata.file_path"))

    stream = stream_id(spark, checkpoint)
    empty = EmptyFiles(spark, path, log_out)

    def land(batch: DataFrame, batch_id: int) -> None:
        # Read once for both outputs; lost blocks are read again from the files.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = batch
            if CORRUPT in batch.columns:
                good = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            write_batch(landing_enrich(good, as_of), out, stream, batch_id)
            write_batch(load_log(batch, as_of, files=empty.unlogged()), log_out, stream, batch_id)
        finally:
            batch.unpersist()

    return (
        source.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(cadence))
        .start()
    )


class EmptyFiles:
    """Files without a byte, which give no rows that a batch could count.

    Spark lists such files but reads nothing from them, so they are the listed ones that cannot be read.  The first look
    of a run goes through the whole folder and the load log.  Later ones ask for files changed since shortly
    before the look before (``MARGIN`` allows for other machines' clocks) and read no log: the empty files of that time are
    remembered.  What a batch costs so does not grow with the history.
    """

    MARGIN = dt.timedelta(minutes=10)
    _NAME = T.StructType([T.StructField("file_name", T.StringType())])

    def __init__(self, spark: SparkSession, path: str, log_out: str):
        self._spark, self._path, self._log_out = spark, path, log_out
        self._since: dt.datetime | None = None
        self._known: dict[str, dt.datetime] = {}

    def unlogged(self) -> DataFrame:
        """``file_name`` of the empty files that have no log row yet."""
        now, since = dt.datetime.now(dt.timezone.utc), self._since
        reader = self._spark.read.format("binaryFile")
        if since is not None:
            reader = reader.option("modifiedAfter", f"{since:%Y-%m-%dT%H:%M:%S}").option("timeZone", "UTC")
        files = reader.load(self._path)
        listed = self._frame([f.replace(":///", ":/", 1) for f in files.inputFiles()])
        empty = listed.join(files.select(F.col("path").alias("file_name")), "file_name", "left_anti")
        if since is None:
            empty = empty.join(read_batches(self._spark, self._log_out, self._NAME), "file_name", "left_anti")
        self._known = {f: at for f, at in self._known.items() if since is None or at >= since}
        fresh = [r["file_name"] for r in empty.collect() if r["file_name"] not in self._known]
        self._known.update(dict.fromkeys(fresh, now))
        self._since = now - self.MARGIN
        return self._frame(fresh)

    def _frame(self, names: list[str]) -> DataFrame:
        return self._spark.createDataFrame([(n,) for n in names], self._NAME)


def incremental_refresh(
    spark: SparkSession,
    raw: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    keys: Sequence[str],
    cadence: str | None = None,
    skip_unchanged: bool = False,
    max_files: int | None = None,
    compacted: VersionedTable | None = None,
) -> StreamingQuery:
    """Carry the current rows of a landing table over to a presented table.

    Versions are appended, never rewritten: a batch costs what it holds, not the size of
    the table.  :func:`presented` gives the newest row per key.  ``skip_unchanged`` leaves
    out rows equal to the stored version, at the price of reading the stored keys.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    stream = stream_id(spark, checkpoint)

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = current_rows(batch)
        if skip_unchanged:
            rows = unchanged_removed(rows, _stored(spark, out, schema, compacted, (stream, batch_id)), keys)
        write_batch(rows, out, stream, batch_id)

    return (
        reader.parquet(raw)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(cadence))
        .start()
    )


def _stored(
    spark: SparkSession,
    out: str,
    schema: T.StructType,
    compacted: VersionedTable | None,
    exclude: tuple[str, int] | None = None,
) -> DataFrame:
    """The compacted versions and the batches that they do not cover, with their origin."""
    rows = read_batches(spark, out, schema, exclude, origin=True)
    if compacted is None or compacted.current_version() is None:
        return rows
    base = compacted.read()
    # One row per stream.  Batches up to it are in the base; their folders are not read again.
    covered = {r[STREAM]: r["last"] for r in base.groupBy(STREAM).agg(F.max(BATCH).alias("last")).collect()}
    newer = F.lit(True)
    for stream, last in covered.items():
        newer = newer & ((F.col(STREAM) != stream) | (F.col(BATCH) > last))
    return base.select(*rows.columns).unionByName(rows.where(newer))


def compact(
    spark: SparkSession, out: str, schema: T.StructType, keys: Sequence[str], compacted: VersionedTable
) -> None:
    """Write the newest versions of all closed batches as one table.

    The last batch of each stream may still be written and is left for the next time.  Nothing is deleted:
    the folders that a committed base covers are no longer read and may be removed later.
    """
    rows = _stored(spark, out, schema, compacted)
    last = rows.groupBy(STREAM).agg(F.max(BATCH).alias("_last"))
    closed = rows.join(last, STREAM).where(F.col(BATCH) < F.col("_last")).drop("_last")
    compacted.write(latest_versions(closed, keys))


def presented(
    spark: SparkSession,
    out: str,
    schema: T.StructType,
    keys: Sequence[str],
    compacted: VersionedTable | None = None,
) -> DataFrame:
    """The newest row per key."""
    return latest_versions(_stored(spark, out, schema, compacted).select(*schema.fieldNames()), keys)
