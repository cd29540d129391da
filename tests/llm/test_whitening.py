"""Whitening against numpy, and its defined cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import whitening
from gaugework.llm.queries import QUERIES
from gaugework.llm.shared import table
from tests.conftest import SF_DIR

ROWS = "id long, vector array<float>"


def brute(vectors, weights="one", k=16):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    distinct, count = np.unique(x, axis=0, return_counts=True)
    w = np.ones(len(distinct), int) if weights == "one" else count
    n, total = int(w.sum()), (distinct * w[:, None]).sum(0)
    z = distinct - total / n
    values, vecs = np.linalg.eigh((z * w[:, None]).T @ z / n)
    order = np.argsort(-values)[:k]
    white = (x - total / n) @ vecs[:, order] / np.sqrt(values[order])
    deviation = [sum(int(v) ** 2 for v in n * row - total) for row in x]
    return n, deviation, white, values[order] / values.sum()


def matches(got, ids, vectors, weights="one", k=16):
    n, deviation, white, explained = brute(vectors, weights, k)
    assert len(got) == len(ids) * white.shape[1]
    assert set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    own = got.pivot_table(index="id", columns="component", values="whitened").loc[ids].to_numpy()
    assert list(sorted(got.component.unique())) == list(range(1, white.shape[1] + 1))
    assert np.abs(own * np.sign((own * white).sum(0)) - white).max() < 1e-8
    by_id = got.drop_duplicates("id").set_index("id").deviation
    assert [int(by_id[i]) for i in ids] == deviation
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-9)


def test_query_is_that_of_numpy(spark):
    got = QUERIES["op11_whiten_embeddings"](spark, SF_DIR)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = table(spark, SF_DIR, "embeddings").toPandas()
    matches(got.withColumnRenamed("vec_id", "id").toPandas(), rows.vec_id.tolist(), np.stack(rows.embedding))


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_count_once_or_as_often_as_they_occur(spark, weights):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 5)).astype(np.float32)
    vectors = np.vstack([base, np.repeat(base[:1], 40, axis=0), base[1:3] + np.float32(1e-7)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], ROWS)
    got = whitening.whiten(rows, components=3, weights=weights).toPandas()
    matches(got, list(range(len(vectors))), vectors, weights, 3)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    plain = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(30)]
    odd = [
        (100, None),
        (101, []),
        (102, [1.0, None, 0.0, 0.0]),
        (103, [1.0, float("nan"), 0.0, 0.0]),
        (104, [float("inf"), 0.0, 0.0, 0.0]),
        (105, [1.0, 2.0]),
        (None, plain[0][1]),
        (3, plain[3][1]),
    ]
    rows = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in plain + odd], ROWS + ", key string, component string, weight string")
    got = whitening.whiten(rows, components=4).toPandas()
    assert set(got.id.dropna()) == set(range(30))
    assert got.id.isna().sum() == 4 and (got.id == 3).sum() == 8
    assert set(got.n) == {30}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, ROWS)).count() == 0


def test_a_dimension_without_spread_has_no_component(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [*rng.normal(size=3).tolist(), 2.0]) for i in range(50)], ROWS)
    got = whitening.whiten(rows).toPandas()
    assert got.component.max() == 3 and got.identity_error.iloc[0] < 1e-9


def test_huge_entries_stay_exact(spark):
    values = [[1e30, 0.0], [-1e30, 1.0], [5.0, 3e9], [1.0, -3e9]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(values)), ROWS), components=1).toPandas()
    x = [[max(-whitening.LIMIT, min(whitening.LIMIT, int(np.floor(64 * float(np.float32(c)))))) + 1_000_000 for c in v] for v in values]
    total = [sum(c) for c in zip(*x)]
    want = [sum((4 * a - s) ** 2 for a, s in zip(v, total)) for v in x]
    assert [int(d) for d in got.sort_values("id").deviation] == want


def test_sums_are_exact(spark):
    big = (1 << 40) - 7
    rows = spark.createDataFrame([([big, -big, 3], 1 << 33), ([1, -1, -5], 3_000_000_009)], "x array<long>, weight long").repartition(2)
    n, total = whitening.sums(rows, "x")
    assert n == (1 << 33) + 3_000_000_009
    assert total == [big * (1 << 33) + 3_000_000_009, -big * (1 << 33) - 3_000_000_009, 3 * (1 << 33) - 15_000_000_045]
    assert rows.select(F.sum("weight")).first()[0] == n
