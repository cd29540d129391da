"""Metric layer: named metrics over logical tables, compiled to one aggregation per table.

Two fact tables are never joined before they are aggregated.  Each table is reduced to
one row per dimension value, and the results are stacked and merged by one more
group-by, which matches NULL dimension values and needs no chain of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import trunc_to
from gaugework.operators.reshape import union_all


@dataclass(frozen=True)
class Metric:
    """``kind`` is count, sum, avg, distinct or pct.

    ``expr`` is the SQL value that is counted or added, ``where`` an SQL condition.  A pct
    metric divides two other metrics of its table, named in ``num`` and ``den``.
    """

    name: str
    table: str
    kind: str
    expr: str | None = None
    where: str | None = None
    num: str | None = None
    den: str | None = None

    def value(self) -> Column:
        value = F.expr(self.expr) if self.expr else F.lit(1)
        return F.when(F.expr(self.where), value) if self.where else value

    def direct(self) -> Column:
        value = self.value()
        return {
            "count": lambda: F.count(value),
            "sum": lambda: F.sum(value),
            "avg": lambda: F.avg(value),
            "distinct": lambda: F.countDistinct(value),
        }[self.kind]()

    # Two-step form, for aggregating before a join.

    def partial(self) -> list[Column]:
        value = self.value()
        if self.kind == "count":
            return [F.count(value).alias(f"{self.name}__n")]
        if self.kind == "sum":
            return [F.sum(value).alias(f"{self.name}__s")]
        if self.kind == "avg":
            return [F.sum(value).alias(f"{self.name}__s"), F.count(value).alias(f"{self.name}__n")]
        raise ValueError(f"{self.kind} has no partial form")

    def merged(self) -> Column:
        if self.kind == "count":
            return F.coalesce(F.sum(f"{self.name}__n"), F.lit(0))
        if self.kind == "sum":
            return F.sum(f"{self.name}__s")
        if self.kind == "avg":
            return F.try_divide(F.sum(f"{self.name}__s"), F.sum(f"{self.name}__n"))
        raise ValueError(f"{self.kind} has no partial form")


@dataclass(frozen=True)
class Relationship:
    """Many-to-one: ``table.key`` refers to ``to.to_key``."""

    table: str
    key: str
    to: str
    to_key: str


@dataclass(frozen=True)
class SemanticView:
    name: str
    sources: Mapping[str, str]
    """Logical table -> usage log."""
    dimensions: Mapping[str, str]
    """Dimension -> logical table that declares it."""
    metrics: tuple[Metric, ...] = ()
    facts: Mapping[str, str] | None = None
    """Fact -> logical table; the caller aggregates facts with ``"sum(fact)"`` or ``"avg(fact)"``."""
    time_dimensions: Mapping[str, str] | None = None
    relationships: tuple[Relationship, ...] = ()
    operands: tuple[Metric, ...] = ()
    """Counts that pct metrics divide by and that are not metrics themselves."""
    snapshots: Mapping[str, str] | None = None
    """Logical table of daily snapshots -> its date column, for ``semi_additive='last'``."""

    # ---- lookups ---------------------------------------------------------------------

    def metric(self, name: str) -> Metric:
        for m in self.metrics:
            if m.name == name:
                return m
        if self.facts and name.endswith(")"):
            kind, _, fact = name[:-1].partition("(")
            if fact in self.facts and kind in ("sum", "avg", "count"):
                return Metric(f"{kind}_{fact}", self.facts[fact], kind, fact)
        raise KeyError(f"{self.name} has no metric {name}")

    def _operand(self, table: str, name: str) -> Metric:
        return next(m for m in (*self.metrics, *self.operands) if (m.table, m.name) == (table, name))

    def metric_names(self, table: str | None = None) -> list[str]:
        return [m.name for m in self.metrics if table in (None, m.table)]

    # ---- compilation ---------------------------------------------------------------------

    def query(
        self,
        table_of: Callable[[str], DataFrame],
        metrics: Sequence[str],
        dimensions: Sequence[str] = (),
        grain: str | None = None,
        filters: Mapping[str, str | Column] | None = None,
        semi_additive: str = "sum",
    ) -> DataFrame:
        """Dimensions, ``period`` (when a grain is given) and the metrics.

        ``table_of`` gives a usage log by name (``UsageCatalog.table``) and is asked for the logs
        in use only; ``filters`` maps logical tables to conditions.
        A dimension is one of the view's that every asked table has, or ``other.column`` of a
        table reached through a relationship.  ``semi_additive='last'`` takes the last snapshot of
        a period instead of adding the days up.
        """
        for d in dimensions:
            if "." not in d and d not in self.dimensions:
                raise KeyError(f"{self.name} has no dimension {d}")
        wanted = [self.metric(name) for name in metrics]
        by_table: dict[str, list[Metric]] = {}
        for m in wanted:
            by_table.setdefault(m.table, []).append(m)
        keys = [_alias(d) for d in dimensions] + (["period"] if grain else [])
        parts = [
            self._aggregate(table_of, table, group, dimensions, grain, (filters or {}).get(table), semi_additive)
            for table, group in by_table.items()
        ]
        names = [m.name for m in wanted]
        if len(parts) == 1:
            return parts[0].select(*keys, *names)
        stacked = union_all(*parts)
        # Every part holds a key once, so max() only picks the one value that is there.
        return stacked.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names]).select(*keys, *names)

    def _with_operands(self, group: list[Metric]) -> list[Metric]:
        base = {m.name: m for m in group if m.kind != "pct"}
        for m in group:
            if m.kind == "pct":
                for name in (m.num, m.den):
                    base.setdefault(name, self._operand(m.table, name))
        return list(base.values())

    def _aggregate(
        self,
        table_of: Callable[[str], DataFrame],
        table: str,
        group: list[Metric],
        dimensions: Sequence[str],
        grain: str | None,
        condition: str | Column | None,
        semi_additive: str,
    ) -> DataFrame:
        rows = table_of(self.sources[table])
        if condition is not None:
            rows = rows.where(condition)
        base = self._with_operands(group)
        local = [d for d in dimensions if "." not in d or d.split(".")[0] == table]
        foreign = [d for d in dimensions if d not in local]
        keys = [F.col(d.split(".")[-1]).alias(_alias(d)) for d in local]
        if grain:
            if table not in (self.time_dimensions or {}):
                raise KeyError(f"{self.name}.{table} has no time dimension")
            keys.append(trunc_to(self.time_dimensions[table], grain).alias("period"))
        values = {m.expr for m in base if m.kind == "distinct"}
        if semi_additive == "last" and table in (self.snapshots or {}) and not foreign:
            reduced = self._last_snapshot(rows, base, keys, self.snapshots[table])
        elif foreign or len(values) > 1 or sum(m.kind == "distinct" for m in base) > 1:
            reduced = self._by_value(table_of, table, rows, base, keys, foreign)
        else:
            reduced = rows.groupBy(*keys).agg(*[m.direct().alias(m.name) for m in base])
        for m in group:
            if m.kind == "pct":
                reduced = reduced.withColumn(
                    m.name, F.try_divide(F.col(m.num).cast("double") * 100, F.col(m.den))
                )
        names = [_alias(d) for d in dimensions] + (["period"] if grain else [])
        return reduced.select(*names, *[m.name for m in group])

    def _by_value(
        self,
        table_of: Callable[[str], DataFrame],
        table: str,
        rows: DataFrame,
        base: list[Metric],
        keys: list[Column],
        foreign: list[str],
    ) -> DataFrame:
        """Each counted value in an aggregation of its own, stacked with the other metrics and merged by key.

        Several distinct counts in one aggregation would multiply every row of the log by their number.  Here all conditions
        on one value are flags of one grouping by that value, which combines map-side and reads two or three
        columns.
        """
        names = [k for k in rows.select(*keys).columns] + [_alias(d) for d in foreign]
        attach = self._attached(table_of, table, foreign) if foreign else None
        link = [F.col(attach[0]).alias("_key")] if foreign else []

        def grouped(own: DataFrame, by: list[Column], columns: list[Column]) -> DataFrame:
            first = own.groupBy(*keys, *link, *by).agg(*columns)
            return first.join(attach[1], "_key", "left") if foreign else first

        plain = [m for m in base if m.kind != "distinct"]
        partials = [c for m in plain for c in m.partial()] + [F.count(F.lit(1)).alias("_rows")]
        parts = [grouped(rows, [], partials).groupBy(*names).agg(F.sum("_rows").alias("_rows"), *[m.merged().alias(m.name) for m in plain])]
        counted: dict[str, list[Metric]] = {}
        for m in base:
            if m.kind == "distinct":
                counted.setdefault(m.expr, []).append(m)
        for expr, own in counted.items():
            flags = [F.max(F.expr(m.where) if m.where else F.lit(True)).alias(m.name) for m in own]
            pairs = grouped(rows.where(F.expr(expr).isNotNull()), [F.expr(expr).alias("_value")], flags)
            if foreign:  # keys of one dimension value may share values
                pairs = pairs.groupBy(*names, "_value").agg(*[F.max(m.name).alias(m.name) for m in own])
            parts.append(pairs.groupBy(*names).agg(*[F.count_if(m.name).alias(m.name) for m in own]))
        # Every part holds a key once, so max() only picks the value that is there; a key without values counts none.
        merged = union_all(*parts).groupBy(*names)
        return merged.agg(
            *[
                (F.coalesce(F.max(m.name), F.lit(0)) if m.kind == "distinct" else F.max(m.name)).alias(m.name)
                for m in base
            ]
        )

    def _attached(self, table_of: Callable[[str], DataFrame], table: str, foreign: list[str]) -> tuple[str, DataFrame]:
        """The key of ``table`` and the related table's ``foreign`` dimensions, one row per ``_key``.

        The log is aggregated by that key before it meets them: a user who ran a third of all queries enters the
        join as one row per dimension value (and per counted value, where values are counted), not as a third of the log.
        """
        targets = {d.split(".")[0] for d in foreign}
        if len(targets) != 1:
            raise KeyError("foreign dimensions must come from one related table")
        target = targets.pop()
        rel = next((r for r in self.relationships if r.table == table and r.to == target), None)
        if rel is None:
            raise KeyError(f"{table} has no relationship to {target}")
        columns = [F.col(d.split(".")[1]).alias(_alias(d)) for d in foreign]
        # Many-to-one: a key stored twice must not multiply the facts.
        related = (
            table_of(self.sources[target])
            .groupBy(F.col(rel.to_key).alias("_key"))
            .agg(F.max(F.struct(*columns)).alias("_one"))
            .select("_key", "_one.*")
        )
        return rel.key, related

    def _last_snapshot(
        self, rows: DataFrame, base: list[Metric], keys: list[Column], date_col: str
    ) -> DataFrame:
        daily = rows.groupBy(*keys, F.col(date_col).alias("_day")).agg(
            *[m.direct().alias(m.name) for m in base]
        )
        names = [c for c in daily.columns if c != "_day" and c not in {m.name for m in base}]
        return daily.groupBy(*names).agg(*[F.max_by(m.name, "_day").alias(m.name) for m in base])


def _alias(dimension: str) -> str:
    return dimension.replace(".", "_")
