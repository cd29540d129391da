"""Registered queries and the SQL each of them is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugework.functions import round_to
from gaugework.session import work_dir
from checks.adapters import (
    EVENTS_AS_OF,
    LINES_AS_OF,
    ORDERS_AS_OF,
    log_frame,
    read_stream,
    read_table,
    with_logs,
)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A work folder in the shared one; a temporary one in local sessions that name none."""
    return work_dir(spark, purpose)


class Logs:
    """The usage logs a query reads, by name.

    A source table is opened once per query, however many logs are drawn from it: opening
    lists the files and reads a footer.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    def __call__(self, name: str) -> DataFrame:
        return log_frame(self.spark, name, self.table)

    def stream(self, name: str) -> DataFrame:
        return log_frame(self.spark, name, lambda t: read_stream(self.spark, self.sf_dir, t))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The last seven days of the events, as the default period has it.
START, END = "2024-01-23 00:00:00", "2024-01-30 23:59:00"
PERIOD = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
EVENTS, LINES, ORDERS = EVENTS_AS_OF, LINES_AS_OF, ORDERS_AS_OF
E_TS, L_TS, O_TS = (f"TIMESTAMP '{t}'" for t in (EVENTS, LINES, ORDERS))


def query(name: str, logs: str, sql: str | None = None):
    """Register ``fn(logs) -> DataFrame``; ``logs`` names the adapters its SQL reads."""

    def register(fn: Callable[[Logs], DataFrame]) -> Callable[[Logs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Logs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_logs(sql, *logs.split()) if logs else sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Fixed digits where an operator returns a raw float, whose last bits depend on the
    order of summation."""
    return df.withColumns({c: round_to(c, digits) for c in cols})


def R(expr: str, digits: int) -> str:
    """SQL: round half away from zero on the decimal value, as Spark does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(36, 9)), {digits}) AS DOUBLE)"


def top(order: str, columns: str, k: int) -> str:
    """SQL: ORDER BY ... LIMIT with every output column as a tie-break."""
    ties = ", ".join(f"{c} ASC NULLS LAST" for c in columns.split())
    return f"ORDER BY {order}, {ties} LIMIT {k}"
