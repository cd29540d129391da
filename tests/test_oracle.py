"""Every query against its SQL."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference
from tests.conftest import SF_DIR



@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    diff, count = difference(spark, con, name, SF_DIR)
    assert diff is None
    assert count >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_results_do_not_depend_on_the_session_zone(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("credits_by_hour", "running_queries", "activity_heatmap", "daily_account_trend", "stream_quota_alerts", "stream_failed_login_alerts"):
            assert difference(spark, con, name, SF_DIR)[0] is None, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_approximate_percentiles_are_close(spark):
    exact = QUERIES["perf_summary"](spark, SF_DIR).first()
    approx = QUERIES["perf_summary_approx"](spark, SF_DIR).first()
    assert approx.total_queries == exact.total_queries
    assert approx.median_close and approx.p95_close
