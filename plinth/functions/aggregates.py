"""Aggregates of measures by the name that a sheet gives them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.selection import percentiles  # noqa: F401  with the other aggregates
from plinth.plans.findings import Refused


def attr(c: Column) -> Column:
    """The one value of a group, null if there are several."""
    return F.when(F.min(c) == F.max(c), F.min(c))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "ctd": F.countDistinct, "countd": F.countDistinct, "median": F.median, "attr": attr,
    "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def aggregate(name: str, c: Column) -> Column:
    if name.lower() not in AGGREGATES:
        raise Refused("measure-unresolved", f"no aggregate {name!r}")
    return AGGREGATES[name.lower()](c)


def apart(keys: Sequence[str], *families: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Each family of aggregates by itself, joined by the keys (nulls are equal). Distinct counts together with
    others make every one of these keep a state for each distinct value; percentiles have large states. Every
    family has its own table: the same rows, with no more tables joined than it needs."""
    out = None
    for df, family in families:
        one = df.groupBy(F.struct(*keys).alias("_g")).agg(*(c.alias(n) for n, c in family.items()))
        out = one if out is None else out.join(one, "_g")
    return out.select(*(F.col("_g")[k].alias(k) for k in keys), *(n for _, family in families for n in family))


def records() -> Column:
    return F.count(F.lit(1))


def percentile(c: Column, p: float) -> Column:
    """Exact; a group's distinct values meet in one task. For groups of any size: ``percentiles``."""
    return F.percentile(c, p)


def corr(a: Column, b: Column) -> Column:
    return F.corr(a, b)


def covar(a: Column, b: Column) -> Column:
    return F.covar_samp(a, b)


def typed_total(name: str, kind: str) -> Column:
    """SUM of a number, MIN of a text."""
    return F.min(name) if kind == "string" else F.sum(name)
