"""Nested levels of detail: FIXED, INCLUDE and EXCLUDE over one another, from one scan of the facts.

All levels that a view asks for lie in a lattice of sets of dimensions. The facts are grouped once by all of these dimensions
together, into states (rows, sum, count, least, greatest of each column), which are written. Every level is then made from the
states of the smallest level made before that contains its dimensions, the finest levels first, and joined to where it is used. A column counted
by distinct values would make nearly a state of each row, so its values are no dimension of the states: the facts' columns are
written once, and the distinct values of a level come from these.

A FIXED or EXCLUDE value is there on each row of the facts, so what aggregates it weighs groups by their rows. An INCLUDE value belongs to its
group, which counts once. Null dimensions are groups like others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.plans.findings import Refused
from plinth.sources.shared import written

AGGREGATES = ("sum", "avg", "min", "max", "count", "countd")


@dataclass(frozen=True)
class Level:
    kind: str
    dims: tuple[str, ...]
    agg: str
    of: str | Level

    def keys(self, context: frozenset[str]) -> frozenset[str]:
        """Its dimensions where those around it are ``context``."""
        own = frozenset(self.dims)
        return {"fixed": own, "include": context | own, "exclude": context - own}[self.kind]


def _level(kind: str, dims: Sequence[str], agg: str, of: str | Level) -> Level:
    if agg not in AGGREGATES or (agg == "countd" and isinstance(of, Level)):
        raise Refused("calc-untranslated", f"{agg} of a level can't be made from states")
    return Level(kind, tuple(dims), agg, of)


def fixed(dims: Sequence[str], agg: str, of: str | Level) -> Level:
    return _level("fixed", dims, agg, of)


def include(dims: Sequence[str], agg: str, of: str | Level) -> Level:
    return _level("include", dims, agg, of)


def exclude(dims: Sequence[str], agg: str, of: str | Level) -> Level:
    return _level("exclude", dims, agg, of)


def _needs(spec: str | Level, agg: str, context: frozenset[str]) -> tuple[set[frozenset[str]], set[str], set[str]]:
    """The levels, the columns with states and those counted by distinct values that a measure asks for."""
    if isinstance(spec, str):
        return {context}, (set() if agg == "countd" else {spec}), ({spec} if agg == "countd" else set())
    own = spec.keys(context)
    levels, columns, distinct = _needs(spec.of, spec.agg, own)
    return levels | {own, context}, columns, distinct


@dataclass
class Lattice:
    """States at the levels made so far, each from the smallest one that contains it."""

    states: dict[frozenset[str], DataFrame]
    columns: frozenset[str]
    facts: DataFrame

    @classmethod
    def over_facts(cls, df: DataFrame, finest: frozenset[str], columns: set[str], distinct: set[str]) -> Lattice:
        """The one scan: states by all dimensions together, written; with columns counted by distinct values the facts are written before."""
        if distinct:
            df = written(df.select(*sorted(finest | columns | distinct)))
        states = [F.count(F.lit(1)).alias("_rows")]
        for c in sorted(columns):
            states += [F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_count_{c}"), F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
        return cls({finest: written(df.groupBy(*sorted(finest)).agg(*states))}, frozenset(columns), df)

    def at(self, keys: frozenset[str]) -> DataFrame:
        if keys not in self.states:
            finer = self.states[min((k for k in self.states if k >= keys), key=lambda k: (len(k), sorted(k)))]
            made = [F.sum("_rows").alias("_rows")]
            for c in sorted(self.columns):
                made += [F.sum(f"_sum_{c}").alias(f"_sum_{c}"), F.sum(f"_count_{c}").alias(f"_count_{c}"), F.min(f"_min_{c}").alias(f"_min_{c}"), F.max(f"_max_{c}").alias(f"_max_{c}")]
            self.states[keys] = finer.groupBy(*sorted(keys)).agg(*made)
        return self.states[keys]

    def value(self, agg: str, column: str, keys: frozenset[str]) -> DataFrame:
        """(keys, ``_v``)."""
        if agg == "countd":
            pairs = self.facts.select(*sorted(keys | {column})).distinct()
            return pairs.groupBy(*sorted(keys)).agg(F.count(column).alias("_v"))
        found = {"avg": F.try_divide(F.col(f"_sum_{column}"), F.col(f"_count_{column}"))}.get(agg, F.col(f"_{agg}_{column}"))
        return self.at(keys).select(*sorted(keys), found.alias("_v"))

    def level(self, spec: Level, context: frozenset[str]) -> tuple[frozenset[str], DataFrame]:
        """Its keys and (keys, ``_v``)."""
        keys = spec.keys(context)
        if isinstance(spec.of, str):
            return keys, self.value(spec.agg, spec.of, keys)
        return keys, self.over(spec.agg, spec.of, keys)

    def over(self, agg: str, inner: Level, keys: frozenset[str]) -> DataFrame:
        """An aggregate by ``keys`` of a level's values."""
        own, values = self.level(inner, keys)
        if inner.kind == "include":
            plain = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[agg]("_v")
            return values.groupBy(*sorted(keys)).agg(plain.alias("_v"))
        rows = _matched(self.at(keys | own).select(*sorted(keys | own), "_rows"), values, sorted(own))
        weighed, known = F.sum(F.col("_v") * F.col("_rows")), F.sum(F.when(F.col("_v").isNotNull(), F.col("_rows")))
        made = {"sum": weighed, "count": F.coalesce(known, F.lit(0)), "avg": F.try_divide(weighed, known), "min": F.min("_v"), "max": F.max("_v")}[agg]
        return rows.groupBy(*sorted(keys)).agg(made.alias("_v"))


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A join in which nulls are equal: by the keys as one struct; without keys the right side is one row."""
    if not keys:
        return left.withColumn("_v", right.select("_v").scalar())
    return left.withColumn("_k", F.struct(*keys)).join(right.select(F.struct(*keys).alias("_k"), *(c for c in right.columns if c not in keys)), "_k", "left").drop("_k")


def view(df: DataFrame, dims: Sequence[str], **measures: tuple[str, str | Level]) -> DataFrame:
    """The view of ``dims`` with measures ``name=(aggregate, column or level)``; an INCLUDE or FIXED level is aggregated to the
    view's rows, an EXCLUDE level has one value on each."""
    around = frozenset(dims)
    needs = [_needs(spec, agg, around) for agg, spec in measures.values()]
    levels, columns, distinct = (set().union(*(n[i] for n in needs)) for i in range(3))
    finest = frozenset().union(around, *levels)
    lattice = Lattice.over_facts(df, finest, columns, distinct)
    for keys in sorted(levels, key=lambda k: (-len(k), sorted(k))):
        lattice.at(keys)
    out = lattice.at(around).select(*dims)
    for name, (agg, spec) in measures.items():
        found = lattice.value(agg, spec, around) if isinstance(spec, str) else lattice.over(agg, spec, around)
        out = _matched(out, found, list(dims)).withColumnRenamed("_v", name)
    return out


def at_rows(df: DataFrame, level: Level, name: str, context: Sequence[str] = ()) -> DataFrame:
    """A level's value beside each row of the facts."""
    around = frozenset(context)
    levels, columns, distinct = _needs(level, "avg", around)
    finest = frozenset().union(*levels)
    lattice = Lattice.over_facts(df, finest, columns, distinct)
    keys, values = lattice.level(level, around)
    return _matched(df, values, sorted(keys)).withColumnRenamed("_v", name)
