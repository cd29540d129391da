from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SF_DIR

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """``docs([(1, "text"), ...])``"""

    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def small_db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
