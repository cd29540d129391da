"""Whitening of embeddings by a covariance that counts every distinct vector with its weight.

Components become integers ``x = floor(scale * c) + shift``, so sums over them are exact and copies are equal.  Rows with the
same ``x`` vector are one entry of the fit list, with weight one or with their number.

1. Copies are found by the SHA-256 of their ``x``; they are combined before they travel, so a vector that a
   third of the rows share costs one row per task.
2. Sums of weights and weighted sums of ``x`` are integers, added up per dimension.
3. Every task multiplies its centred entries (``x - S / n``) into one weighted Gram matrix; the matrices are added up row by
   row.  Only the ``d`` by ``d`` result reaches the driver, where its eigenvectors are found.
4. Each distinct vector is whitened once; rows get the result by a join on the digest, whose hot keys adaptive
   execution splits.  The covariance of what was whitened is measured in the same way, not assumed.

Defined cases: vectors that are NULL, empty or hold NULL or non-finite components take no part, nor do those of
another length than most (the longer of two equally frequent lengths counts); NULL and repeated ids are kept, one result
each; ``x`` is held within ``+-LIMIT``, beyond which it would not fit; components without spread (eigenvalue below
``RANK`` of the largest) cannot be whitened and give no rows, so a single distinct vector gives none; an empty table gives no
rows; other columns are ignored.  The matrix bounds the dimension: 8 MB at 1,024 components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import written

SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 40
#: Eigenvalues below this share of the largest are rounding, not spread.
RANK = 1e-11


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def integers(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id, key, x`` of the usable rows of ``id, vector``; ``key`` is the digest of ``x``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = _matrix(batch.column(1)).astype(np.float64)
                x = np.clip(np.floor(scale * c), -LIMIT, LIMIT).astype("<i8") + shift
                keys = [hashlib.sha256(row.tobytes()).digest() for row in x]
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                xs = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), xs], names=["id", "key", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vector").mapInArrow(convert, f"id {kind}, key binary, x array<bigint>")


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows ``at, part`` (doubles as bytes) added up per ``at``; whoever adds holds its own sums only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(part.as_buffer())
                sums[at] = sums[at] + own if at in sums else own.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["at", "part"]
            )

    shape = "at int, part binary"
    return {at: np.frombuffer(bytes(part)) for at, part in parts.repartition("at").mapInArrow(add, shape).collect()}


def _emit(rows: np.ndarray) -> pa.RecordBatch:
    parts = [r.tobytes() for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["at", "part"])


def sums(entries: DataFrame, column: str) -> tuple[int, list[int]]:
    """The sum of ``weight`` and the weighted integer sum of every dimension of ``column``, both exact.

    A task adds up halves of 32 bits, whose sums stay within 64 bits; Spark adds the tasks' decimals.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            if batch.num_rows:
                v, w = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                v = np.hstack([v, np.ones((len(v), 1), np.int64)])
                halves = ((v & 0xFFFFFFFF) * (w & 0x7FFFFFFF), (v >> 32) * (w & 0x7FFFFFFF), v * (w >> 31))
                (a, b), (c, d), (e, f) = (((p & 0xFFFFFFFF).sum(0).tolist(), (p >> 32).sum(0).tolist()) for p in halves)
                own = [lo + (x << 32) + (y << 32) + (hi << 64) + (z << 31) + (t << 63) for lo, x, y, hi, z, t in zip(a, b, c, d, e, f, strict=True)]
                total = [x + y for x, y in zip(total, own, strict=True)] if total else own
        if total:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                names=["at", "part"],
            )

    parts = entries.select(column, "weight").mapInArrow(count, "at int, part decimal(38,0)")
    got = {at: int(part) for at, part in parts.groupBy("at").agg(F.sum("part")).collect()}
    exact = [got[i] for i in range(len(got))]
    return (exact[-1], exact[:-1]) if exact else (0, [])


def means(entries: DataFrame, column: str) -> np.ndarray:
    """The weighted mean of every dimension of a column of doubles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v, w = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                own = np.append(w @ v, w.sum())
                total = own if total is None else total + own
        if total is not None:
            yield _emit(total[None, :])

    got = _added(entries.select(column, "weight").mapInArrow(count, "at int, part binary"))
    return got[0][:-1] / got[0][-1]


def covariance(entries: DataFrame, column: str, total: int, centred) -> np.ndarray:
    """The covariance of ``column``, divisor ``total``; ``centred`` takes a matrix of its rows to deviations from the mean."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            if batch.num_rows:
                z = centred(_matrix(batch.column(0)))
                w = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                own = (z * w[:, None]).T @ z
                gram = own if gram is None else gram + own
        if gram is not None:
            yield _emit(gram)

    got = _added(entries.select(column, "weight").mapInArrow(multiply, "at int, part binary"))
    return np.vstack([got[i] for i in range(len(got))]) / total


def _squares(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if d.size == 0 or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62:
        return (d.astype(np.int64) ** 2).sum(1).tolist() if d.size else [0] * len(d)
    return [sum(v * v for v in row) for row in d.tolist()]


def whiten(rows: DataFrame, components: int = 16, weights: str = "one", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every usable row of ``id, vector``.

    ``weights`` is ``one`` (each distinct vector counts once) or ``count`` (as often as it occurs).  ``n`` is the sum of the
    weights, ``deviation`` the exact sum of ``(n * x - S)^2`` over the dimensions, ``identity_error`` the largest
    absolute entry of the whitened entries' covariance minus the identity.  Components are numbered from 1 by falling
    eigenvalue; a component's first non-zero loading is positive.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    id_kind = rows.schema["id"].dataType.simpleString()
    empty = f"id {id_kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    good = rows.select("id", "vector").where(usable("vector"))
    length = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if length is None:
        return spark.createDataFrame([], empty)
    coded = integers(good.where(F.size("vector") == length["size"]), scale, shift)
    weight = F.lit(1).cast("bigint") if weights == "one" else F.count("*")
    entries = written(coded.groupBy("key", "x").agg(weight.alias("weight")))
    n, total = sums(entries, "x")
    centre = _Centre(n, total)
    values, vectors = np.linalg.eigh(covariance(entries, "x", n, centre))
    order = np.argsort(-values, kind="stable")
    trace = float(values.sum())
    order = order[values[order] > max(values.max(), 0.0) * RANK][:components]
    if not len(order):
        return spark.createDataFrame([], empty)
    basis = vectors[:, order]
    first = np.array([column[np.flatnonzero(np.abs(column) > 1e-12)[0]] for column in basis.T])
    basis = basis * np.sign(first) / np.sqrt(values[order])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                white = centre(x) @ basis
                ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
                squares = [Decimal(v) for v in _squares(centre.scaled(x))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.ListArray.from_arrays(ends, pa.array(white.ravel())),
                        pa.array(squares, pa.decimal128(38, 0)),
                    ],
                    names=["key", "weight", "white", "deviation"],
                )

    shape = "key binary, weight bigint, white array<double>, deviation decimal(38,0)"
    white = written(entries.select("key", "x", "weight").mapInArrow(project, shape))
    mean = means(white, "white")
    own = covariance(white, "white", n, lambda v: v - mean)
    error = float(np.abs(own - np.eye(len(order))).max())
    explained = F.array(*(F.lit(float(values[i]) / trace) for i in order))
    joined = coded.select("id", "key").join(white.drop("weight"), "key")
    return joined.select("id", "deviation", F.posexplode("white").alias("_at", "whitened")).select(
        "id",
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


class _Centre:
    """Deviations from the exact mean ``total / n``."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n, self.total = n, total

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: in 64 bits where it fits, else as Python integers."""
        if x.size and max(abs(s) for s in self.total) < 2**62 and self.n * int(np.abs(x).max()) < 2**62:
            return x * self.n - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, rounded once: the whole part of the mean is taken off as an integer first."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.total])
        return (x - whole).astype(np.float64) - rest
