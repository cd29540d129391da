"""Batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.operators.filters import partition_column


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> None:
    """Plain Parquet write.

    Partitioned output is rebalanced first: rows of a partition value come together into
    few files, and adaptive execution splits a value that holds much of the data.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    # What "overwrite" replaces must not hang on a session setting: the partitions that are written.
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    writer.partitionBy(*partition_by).parquet(path)


def write_usage_log(df: DataFrame, path: str, ts_col: str, mode: str = "append") -> None:
    """A usage log in date folders, so the time filters prune directories."""
    date_col = partition_column(ts_col)
    write_table(df.withColumn(date_col, F.to_date(ts_col)), path, mode, [date_col])


def clustered(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``col`` for row-group min/max skipping.

    The row's hash is the second range key, so a value that holds a third of the rows
    spreads over a third of the tasks, however many there are.  It depends on the row alone: a
    task that is run again after a lost executor computes the same layout.
    """
    hashable = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    salted = df.withColumn("_salt", F.xxhash64(*hashable))
    keys = ([partitions] if partitions else []) + [F.col(col), F.col("_salt")]
    return salted.repartitionByRange(*keys).sortWithinPartitions(col).drop("_salt")


def write_clustered(
    df: DataFrame, path: str, col: str, mode: str = "append", partitions: int | None = None
) -> None:
    clustered(df, col, partitions).write.mode(mode).parquet(path)


class VersionedTable:
    """A control table kept as whole versions, for one writer at a time.

    A version becomes visible when its number is added to the commit list, after its data
    is complete; the version being read is never overwritten, and a failed write leaves
    the table as it was.
    """

    _COMMIT = T.StructType([T.StructField("version", T.LongType())])

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def current_version(self) -> int | None:
        try:
            commits = self.spark.read.schema(self._COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return commits.agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current_version() if version is None else version
        if version is None:
            raise ValueError(f"no committed version in {self.root}")
        return self.spark.read.parquet(self._data(version))

    def write(self, df: DataFrame) -> int:
        current = self.current_version()
        version = 0 if current is None else current + 1
        # Overwrite clears what a failed attempt at this version left behind.
        df.write.mode("overwrite").parquet(self._data(version))
        self.spark.createDataFrame([(version,)], self._COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.root}/commits"
        )
        return version

    def _data(self, version: int) -> str:
        return f"{self.root}/data/v{version:08d}"
