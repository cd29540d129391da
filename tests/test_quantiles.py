import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gaugework.functions import exact_percentiles, quantiles, value_counts

PS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def check(spark, data: list[tuple]):
    df = spark.createDataFrame(data, "k string, v long")
    out = {
        r.k: r
        for r in exact_percentiles(value_counts(df, ["k"], "v"), ["k"], "v", PS).collect()
    }
    groups: dict = {}
    for k, v in data:
        groups.setdefault(k, [])
        if v is not None:
            groups[k].append(v)
    assert set(out) == set(groups)
    for k, values in groups.items():
        for name, p in PS.items():
            got = out[k][name]
            if not values:
                assert got is None
            else:
                assert got == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=1e-5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.integers(-5, 5), st.integers(-(10**7), 10**12)),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_matches_numpy(spark, data):
    check(spark, data)


def test_one_hot_key_and_value(spark):
    data = [("hot", 7)] * 3000 + [("hot", v) for v in range(1000)] + [(f"k{i}", i) for i in range(50)]
    check(spark, data)


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v long")
    row = exact_percentiles(value_counts(df, [], "v"), [], "v", {"p50": 0.5}).first()
    assert row.p50 == 25.0
    empty = exact_percentiles(value_counts(df.where("v < 0"), [], "v"), [], "v", {"p50": 0.5}).collect()
    assert [r.p50 for r in empty] == [None]


def test_small_and_infinite_values(frame):
    df = frame("v double", [(1e-7,), (3e-7,)])
    row = exact_percentiles(value_counts(df, [], "v"), [], "v", {"p50": 0.5}).first()
    assert row.p50 == 2e-7
    inf = float("inf")
    df = frame("v double", [(-inf,), (1.0,), (inf,), (inf,)])
    row = exact_percentiles(value_counts(df, [], "v"), [], "v", {"p0": 0.0, "p30": 1 / 3, "p100": 1.0}).first()
    assert (row.p0, row.p30, row.p100) == (-inf, 1.0, inf)


NARROW = {
    "narrow": lambda rng: 1000 + 0.2 * rng.random(60_000),
    "clustered": lambda rng: 1 + np.concatenate([[0.0015], 1e-9 * rng.random(30_000), 1e-12 * rng.random(30_000)]),
    "tiny": lambda rng: np.concatenate([rng.choice([-1, 1], 20_000) * 10.0 ** rng.uniform(-300, -9, 20_000), [0.0, 5e-324, 1e300]]),
    "neighbours": lambda rng: np.nextafter(7.0, 8.0) + np.arange(40_000) * np.spacing(7.0),
}


@pytest.mark.parametrize("name", sorted(NARROW))
def test_narrow_values_are_ranked_in_bounded_groups(spark, monkeypatch, name):
    """Percentiles of values that share a bucket, and how many of them one window ranks."""
    values = np.unique(NARROW[name](np.random.default_rng(5)))
    df = spark.createDataFrame(values.reshape(-1, 1).tolist(), "v double")
    split, ranked = quantiles._split, []

    def counted(*args):
        out = split(*args)
        ranked.append(out.groupBy("before").count())
        return out

    monkeypatch.setattr(quantiles, "_split", counted)
    row = exact_percentiles(value_counts(df, [], "v"), [], "v", PS).first()
    for column, p in PS.items():
        assert row[column] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-320)
    most = ranked[0].agg({"count": "max"}).first()[0]
    # Only values closer than a millionth of their bucket's width stay together.
    assert most <= (len(values) if name == "clustered" else 64)


def test_nan_is_the_greatest(frame):
    df = frame("v double", [(1.0,), (2.0,), (float("nan"),)])
    row = exact_percentiles(value_counts(df, [], "v"), [], "v", {"p0": 0.0, "p50": 0.5}).first()
    assert (row.p0, row.p50) == (1.0, 2.0)
