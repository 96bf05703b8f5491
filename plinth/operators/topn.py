"""Top-N sets and gates by the order of a view, in the order of operations of sheets.

A top-N set ranks over the rows that the context filters leave, not over those of other filters; a gate
(the first N of the view) ranks over what all other filters leave. Both give a set of keys, of N rows, and
the base table is semi-joined with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.lod import fixed
from plinth.plans.findings import INFO, WARNING, Findings, Refused

#: Keys up to which the set is broadcast.
BROADCAST = 100_000


def leaders(df: DataFrame, dim: str, by: Column, n: float, *, bottom: bool = False) -> DataFrame:
    """The N members with the greatest (or least) value, ties by the member; members without value are out."""
    if int(n) != n or n < 0:
        raise Refused("topn-not-pushed", f"{n} is no number of members")
    ranked = df.groupBy(dim).agg(by.alias("_by")).where(F.col("_by").isNotNull())
    return ranked.orderBy(F.asc("_by") if bottom else F.desc("_by"), dim).limit(int(n)).select(dim)


def _within(df: DataFrame, keys: DataFrame, dim: str, n: float) -> DataFrame:
    return df.join(F.broadcast(keys) if n <= BROADCAST else keys, dim, "left_semi")


def top_n(df: DataFrame, dim: str, by: Column, n: float, *, bottom: bool = False, context: Column | None = None) -> DataFrame:
    """The rows of ``df`` whose ``dim`` is in the set; the context filter holds for set and rows."""
    base = df if context is None else df.where(context)
    return _within(base, leaders(base, dim, by, n, bottom=bottom), dim, n)


def top_n_view(df: DataFrame, dim: str, measures: dict[str, Column], by: Column, n: float, *, bottom: bool = False, context: Column | None = None) -> DataFrame:
    """A view of the members of a top-N set, grouped by that dimension, when no other filter acts: members are
    ranked and measured in one pass over the table."""
    if int(n) != n or n < 0:
        raise Refused("topn-not-pushed", f"{n} is no number of members")
    base = df if context is None else df.where(context)
    view = base.groupBy(dim).agg(*(m.alias(k) for k, m in measures.items()), by.alias("_by")).where(F.col("_by").isNotNull() & F.col(dim).isNotNull())
    return view.orderBy(F.asc("_by") if bottom else F.desc("_by"), dim).limit(int(n)).drop("_by")


def top_n_fixed(df: DataFrame, dim: str, level: Sequence[str], value: Column, by: Column, n: float, sheet: str, findings: Findings, *, bottom: bool = False) -> DataFrame:
    """By an aggregate ``by`` over the column ``_fixed_value``, which is ``value`` fixed to ``level`` and is there on every row:
    an average weighs a level by its rows. The ranking sees the table before other filters."""
    findings.add(INFO, sheet, "topn-order-of-ops", f"{dim} is ranked over all rows by a value fixed to {', '.join(level)}")
    return _within(df, leaders(fixed(df, level, _fixed_value=value), dim, by, n, bottom=bottom), dim, n)


def top_n_checked(df: DataFrame, dim: str, column: str, n: float, sheet: str, findings: Findings) -> DataFrame:
    """By the sum of a column; without that column the filter is dropped, and said so."""
    if column not in df.columns:
        findings.add(WARNING, sheet, "topn-column-missing", f"{column} is not there to rank {dim}")
        return df
    return top_n(df, dim, F.sum(column), n)


def top_n_parameter(df: DataFrame, dim: str, by: Column, parameters: dict[str, float], name: str, *, bottom: bool = False, context: Column | None = None) -> DataFrame:
    """N by a parameter; one that isn't known is refused."""
    if name not in parameters:
        raise Refused("topn-not-pushed", f"no parameter {name}")
    return top_n(df, dim, by, parameters[name], bottom=bottom, context=context)


def gate(df: DataFrame, dim: str, n: int, sheet: str, findings: Findings, *, by: Column | None = None, ascending: bool = False, filters: Sequence[Column] = ()) -> DataFrame:
    """INDEX() <= N or RANK() <= N: the first N members in the sheet's sort, after all other filters. A sheet
    without a sort has no first members, so the gate is dropped, and said so."""
    base = df
    for f in filters:
        base = base.where(f)
    if by is None:
        findings.add(WARNING, sheet, "view-order-filter-not-pushed", f"{dim} has no sort")
        return base
    findings.add(INFO, sheet, "view-order-filter-pushed", f"first {n} of {dim}")
    return _within(base, leaders(base, dim, by, n, bottom=ascending), dim, n)
