"""Idempotent output of ``foreachBatch``: one folder per stream and micro-batch.

A batch that is run again after a failure overwrites its own folder, so every row is
stored once whatever happens in between.  Batch numbers begin anew with every checkpoint, so the
stream's own id is part of the path: streams into one table never touch each other's folders, and a
stream whose checkpoint was replaced is a new stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STREAM, BATCH = "stream", "batch_id"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """None before anything was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id kept beside a stream's checkpoint; made when the checkpoint is new."""
    path = f"{checkpoint.rstrip('/')}/stream_id"
    schema = T.StructType([T.StructField("id", T.StringType())])
    stored = _read(spark, path, schema)
    if stored is None:
        spark.createDataFrame([(uuid.uuid4().hex,)], schema).coalesce(1).write.parquet(path)
        stored = _read(spark, path, schema)
    return stored.first()["id"]


def write_batch(
    df: DataFrame, path: str, stream: str, batch_id: int, partition_by: Sequence[str] = ()
) -> None:
    folder = f"{path.rstrip('/')}/{STREAM}={stream}/{BATCH}={batch_id}"
    # The whole folder is the batch's, whatever the session says about partitions.
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*partition_by).parquet(folder)


def read_batches(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    exclude: tuple[str, int] | None = None,
    origin: bool = False,
) -> DataFrame:
    """All stored batches, without the one being written; empty before the first.

    ``origin`` keeps the columns ``stream`` and ``batch_id``, by which folders can be pruned.
    """
    marks = [T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())]
    full = T.StructType([*schema.fields, *marks])
    df = _read(spark, path, full)
    if df is None:
        return spark.createDataFrame([], full if origin else schema)
    if exclude is not None:
        df = df.where((df[STREAM] != exclude[0]) | (df[BATCH] != exclude[1]))
    # Folders by other columns show up as well.
    return df.select(*schema.fieldNames(), *((STREAM, BATCH) if origin else ()))


# Schedules offered for recurring loads, as processing-time triggers.
CADENCES = ("1 minute", "5 minutes", "15 minutes", "30 minutes", "1 hour", "6 hours", "1 day")


def trigger(cadence: str | None) -> dict[str, object]:
    """``None`` takes what is there and stops; otherwise a recurring trigger."""
    if cadence is None:
        return {"availableNow": True}
    if cadence not in CADENCES:
        raise ValueError(f"cadence must be one of {CADENCES}")
    return {"processingTime": cadence}
