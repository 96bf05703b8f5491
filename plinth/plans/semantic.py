"""Named metrics over a model: defined once, asked for by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.plans import analysed
from plinth.plans.findings import Refused


@dataclass(frozen=True)
class Metric:
    """``sql``: an aggregate of columns; ``columns``: those it reads."""

    name: str
    sql: str
    columns: tuple[str, ...]
    synonyms: tuple[str, ...] = ()


@dataclass
class Model:
    """``tables``: of each table its DataFrame, or the names of its columns. What a metric reads and where it fits is what Spark's analysis says
    of its text over the DataFrames; for names alone the caller says which columns it reads."""

    tables: dict[str, DataFrame | Sequence[str]]
    metrics: dict[str, Metric] = field(default_factory=dict)

    def known(self, sql: str) -> list[tuple[str, DataFrame]]:
        """The tables over which a metric can be computed."""
        return [(t, df) for t, df in self.tables.items() if isinstance(df, DataFrame) and analysed.fits(df, sql)]

    def same(self, a: str, b: str) -> bool:
        """Texts that differ in blanks and case alone, or mean the same over a table."""
        one, two = (" ".join(x.split()).upper() for x in (a, b))
        return one == two or any(analysed.fits(df, b) and analysed.same(df, a, b) for _, df in self.known(a))

    def define(self, name: str, sql: str, columns: Sequence[str] | None = None) -> Metric:
        """A metric that is known already becomes a synonym; of its names the one with blanks, as people
        write, is preferred."""
        if columns is None:
            fitting = self.known(sql)
            if not fitting:
                raise Refused("measure-unresolved", f"no table has what {name!r} reads")
            columns = analysed.columns(fitting[0][1], sql)
        for old in list(self.metrics.values()):
            if self.same(old.sql, sql):
                keep, other = (name, old.name) if " " in name and " " not in old.name else (old.name, name)
                del self.metrics[old.name]
                self.metrics[keep] = Metric(keep, old.sql, old.columns, tuple(dict.fromkeys([*old.synonyms, other])))
                return self.metrics[keep]
        self.metrics[name] = Metric(name, sql, tuple(columns))
        return self.metrics[name]

    def find(self, name: str) -> Metric:
        for m in self.metrics.values():
            if name == m.name or name in m.synonyms:
                return m
        raise Refused("measure-unresolved", f"no metric {name!r}")

    def placed(self, name: str) -> str:
        """The first table that has all of the metric's columns."""
        metric = self.find(name)
        for t, table in self.tables.items():
            if analysed.fits(table, metric.sql) if isinstance(table, DataFrame) else set(metric.columns) <= set(table):
                return t
        raise Refused("measure-unresolved", f"no table has all of {metric.columns}")

    def query(self, df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
        """All metrics by all dimensions in one aggregation."""
        found = {n: F.expr(self.find(n).sql).alias(n) for n in metrics}
        return (df if where is None else df.where(where)).groupBy(*by).agg(*found.values())
