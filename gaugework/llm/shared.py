"""What several operators share: cut lineage, slices of bounded size, shingle hashes, labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.session import shared_dir

SLICE_BYTES = 4 << 20
#: Texts go to Python in batches of about so many bytes.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may have none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder."""
    set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, and safe from lost executors."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again, column by column."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session sends batches of about ``BATCH_BYTES`` to Python, unless the caller has set a bound.

    By Spark's own bounds (10,000 rows, 64 MB) a batch of texts holds tens of MB.  The JVM has it several times over outside its
    heap, for every core, and so has the Python worker.  Results do not depend on batches.  The setting stays, since
    frames that are returned run after the call.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns; ``df`` must not have columns of these names."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in columns.items())])


def fold(id_col: str, n: int) -> Column:
    """``crc32(id as text) mod n``; NULL ids belong to no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int
) -> DataFrame:
    """``text, label`` of at most ``limit`` labelled rows for which ``train`` holds.

    The rows with the smallest hash of their id are taken, the same ones on every run.  The
    sample of ids and labels has ``limit`` rows at most (16 bytes each), so it is broadcast.
    Rows without id or label take no part; an id labelled twice counts with its larger label.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isin(0, 1))
        .withColumnRenamed("_id", "doc_id")
        .where(train)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of runs of texts of about ``max_bytes``; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield start, stop - start
        start = stop


def strings(column: pa.Array) -> pa.Array:
    """A plain string array with NULL as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x
