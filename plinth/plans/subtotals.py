"""Subtotals and grand totals of a view: grouping sets.

Sums, counts, extremes and ratios come from the view's own groups: the facts are grouped once, and only these groups are laid out for each set.
Distinct counts are made from the distinct values of each group, percentiles by radix selection for all sets together: neither can be summed up. Then
the columns are written once, so the joins behind them are done once.

Facts whose dimensions hang on a key of theirs (an order's customer) may be ``folded`` by that key before their dimensions are joined: states, and the values of
percentiles as lists of their images. Then one exchange by the key moves them, and no join with a large dimension moves them again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.selection import imaged, selected
from plinth.plans.findings import Refused
from plinth.sources.shared import written

Measure = tuple[str, ...]


def rollup(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """The details, a subtotal for each leading dimension, the grand total."""
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def cube(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """Subtotals of rows and of columns: every set of dimensions."""
    return [tuple(d for i, d in enumerate(dims) if not mask >> (len(dims) - 1 - i) & 1) for mask in range(1 << len(dims))]


def _level(dims: Sequence[str], kept: Sequence[str]) -> int:
    """Spark's grouping id: a bit for each dimension that is summed over, the first dimension's the highest."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def _sets(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], **made: Column) -> DataFrame:
    found = df.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(F.grouping_id().cast("int").alias("LEVEL"), *(c.alias(n) for n, c in made.items()))
    return found.select(F.struct(*dims, "LEVEL").alias("_g"), *made)


PLAIN = ("sum", "avg", "min", "max", "count", "rows", "ratio")


def _states(measures: dict[str, Measure]) -> dict[str, tuple[str, str | None]]:
    """What the measures that can be summed up are made from: name to aggregate and column."""
    states: dict[str, tuple[str, str | None]] = {"_rows": ("count", None)}
    for kind, *columns in (m for m in measures.values() if m[0] in PLAIN):
        for c in columns:
            states |= {f"_{k}_{c}": (k, c) for k in {"avg": ("sum", "count"), "ratio": ("sum",)}.get(kind, (kind,))}
    return states


AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def folded(df: DataFrame, keys: Sequence[str], measures: dict[str, Measure]) -> DataFrame:
    """A row for each of the keys (null is one), for ``subtotals(..., fold=True)`` once the dimensions are joined. Columns of distinct counts must be joined, too, or be keys.
    A key's values are one row's, so keys are to be such that few rows share one."""
    lists = {m[1]: f"_all_{m[1]}" for m in measures.values() if m[0] in ("median", "percentile")}
    for c, n in lists.items():
        df = imaged(df.withColumn(n, F.col(c)), n).withColumnRenamed("_u", n)
    made = [AGGREGATES[k](F.lit(1) if c is None else F.col(c)).alias(n) for n, (k, c) in _states(measures).items()]
    return df.groupBy(*keys).agg(*made, *(F.collect_list(n).alias(n) for n in lists.values()))


def subtotals(df: DataFrame, dims: Sequence[str], measures: dict[str, Measure], sets: Sequence[Sequence[str]], *, fold: bool = False) -> DataFrame:
    """``measures``: name to (sum, avg, min, max or count, column), (rows,), (ratio, column, column), (countd, column), (median, column) or
    (percentile, column, share). A row for each group of each set: dimensions that are summed over are null, and ``LEVEL`` has a bit for each.
    ``fold``: the rows are those of ``folded``, with their dimensions."""
    plain = {n: m for n, m in measures.items() if m[0] in PLAIN}
    rest = {n: m for n, m in measures.items() if n not in plain}
    if bad := [n for n, m in rest.items() if m[0] not in ("countd", "median", "percentile")]:
        raise Refused("measure-unresolved", f"no subtotals of {', '.join(bad)}")
    states = _states(measures)
    if fold:
        df = df.select(*dict.fromkeys([*dims, *states, *(m[1] if m[0] == "countd" else f"_all_{m[1]}" for m in rest.values())]))
    else:
        df = df.select(*dict.fromkeys([*dims, *(c for m in measures.values() for c in (m[1:2] if m[0] == "percentile" else m[1:]))]))
    if rest:  # read more than once
        df = written(df)
    if fold:
        groups = df.groupBy(*dims).agg(*((F.sum if k == "count" else AGGREGATES[k])(n).alias(n) for n, (k, _) in states.items()))
    else:
        groups = df.groupBy(*dims).agg(*(AGGREGATES[k](F.lit(1) if c is None else F.col(c)).alias(n) for n, (k, c) in states.items()))

    def value(m: Measure) -> Column:
        if m[0] == "rows":
            return F.sum("_rows")
        if m[0] in ("sum", "count"):
            return F.sum(f"_{m[0]}_{m[1]}")
        if m[0] in ("min", "max"):
            return {"min": F.min, "max": F.max}[m[0]](f"_{m[0]}_{m[1]}")
        return F.try_divide(F.sum(f"_sum_{m[1]}"), F.sum(f"_count_{m[1]}") if m[0] == "avg" else F.sum(f"_sum_{m[2]}"))

    parts = [_sets(groups, dims, sets, **({n: value(m) for n, m in plain.items()} or {"_rows": F.sum("_rows")}))]
    for n, m in rest.items():
        if m[0] == "countd":
            pairs = df.select(*dims, F.col(m[1]).alias("_v")).distinct()
            parts.append(_sets(pairs, dims, sets, **{n: F.countDistinct("_v")}))
        else:
            of = F.struct(*dims) if dims else F.struct(F.lit(0).alias("_one"))
            into = [F.struct(*(F.col("_g")[d].alias(d) if d in s else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims), F.lit(_level(dims, s)).alias("LEVEL")) for s in sets]
            values = df.select(*dims, F.explode(f"_all_{m[1]}").alias(m[1])) if fold else df
            parts.append(selected(values, of, m[1], {n: 0.5 if m[0] == "median" else float(m[2])}, into, images=fold))
    out = reduce(lambda a, b: a.join(b, "_g", "left"), parts)
    return out.select(*(F.col("_g")[d].alias(d) for d in dims), F.col("_g")["LEVEL"].alias("LEVEL"), *measures)
