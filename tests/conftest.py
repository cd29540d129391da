from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gaugework.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("a long, b string", [(1, "x")])``"""

    def make(schema: str, rows):
        return spark.createDataFrame(rows, schema)

    return make


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def by_key(df, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.collect()}
