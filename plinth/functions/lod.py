"""Level-of-detail values and table calculations.

A value fixed to some keys is aggregated by those keys and joined back, so a key that holds a third of the
rows is summed up in every task first; a window over the keys would bring its rows into one. Values over a
whole view are computed on its grouped rows; where they need no order, as a scalar subquery, else by ``scan``, which
writes the view in ranges. There is no window without partitions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import scan
from plinth.plans.findings import Refused

#: Table calculations without an exact translation.
UNSUPPORTED = (
    "LOOKUP", "FIRST", "LAST", "RUNNING_SUM", "RUNNING_AVG", "RUNNING_MIN", "RUNNING_MAX", "RUNNING_COUNT", "TOTAL", "PREVIOUS_VALUE", "SIZE", "WINDOW_STDEV", "WINDOW_VAR",
    "WINDOW_PERCENTILE", "WINDOW_CORR", "RANK_MODIFIED", "RANK_PERCENTILE", "INCLUDE", "EXCLUDE", "DATELINE",
)


def refuse(function: str) -> None:
    """``function``: a name, or a call. Frames (offsets after the value) are refused like the functions. A calculation that says in
    which order and level it is meant has its functions in ``scan`` and ``levels``."""
    name, _, rest = function.upper().partition("(")
    if name.startswith("WINDOW_") and re.search(r",\s*(-?\d+|FIRST\(\)|LAST\(\))", rest):
        raise Refused("calc-untranslated", f"{function}: a frame inside the view")
    if name.strip() in UNSUPPORTED:
        raise Refused("calc-untranslated", f"{function} depends on an order or a level that isn't given")


def fixed(df: DataFrame, keys: Sequence[str], *, source: DataFrame | None = None, **values: Column) -> DataFrame:
    """Adds ``{FIXED keys : AGG}`` to each row; null keys are a group like others. Both sides of the join have the
    keys as one struct, in which nulls are equal, so the aggregate is exchanged only once. ``source``: the same
    rows with no more tables joined than keys and values need, to aggregate."""
    keyed = df.withColumn("_fixed", F.struct(*keys))
    made = (keyed if source is None else source.withColumn("_fixed", F.struct(*keys))).groupBy("_fixed").agg(*(v.alias(n) for n, v in values.items()))
    return keyed.join(made, "_fixed").select(*df.columns, *values)


def overall(df: DataFrame, value: Column) -> Column:
    """``{AGG}``: one value of a whole table, as a scalar subquery."""
    return df.select(value).scalar()


def window_total(view: DataFrame, **values: Column) -> DataFrame:
    """WINDOW_SUM, _AVG, _MIN, _MAX, _COUNT or _MEDIAN: an aggregate of the view's rows beside each. All of
    them are one scalar subquery, so the view is computed twice however many there are."""
    whole = overall(view, F.struct(*(v.alias(n) for n, v in values.items())))
    return view.withColumn("_whole", whole).select(*view.columns, *(F.col("_whole")[n].alias(n) for n in values))


def ranked(view: DataFrame, value: str, name: str = "RANK", *, kind: str = "rank", ascending: bool = False, within: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """RANK, RANK_DENSE, RANK_MODIFIED, RANK_PERCENTILE or RANK_UNIQUE (``ties`` decides) of the view's rows, nulls last."""
    found = scan.scan(view, [scan.Key(value, ascending), *ties], within=within, **{name: scan.rank(kind)})
    return found if kind == "percentile" else found.withColumn(name, F.col(name).cast("int"))


def indexed(view: DataFrame, order: Sequence[scan.Key | str], name: str = "INDEX") -> DataFrame:
    """INDEX(): the place of a row in the view's order."""
    return scan.scan(view, order, **{name: scan.index()}).withColumn(name, F.col(name).cast("int"))


def share_of(view: DataFrame, value: str, name: str = "PCT") -> DataFrame:
    return view.withColumn(name, F.try_divide(F.col(value), overall(view, F.sum(value))))


def equals_extreme(view: DataFrame, value: str, name: str, extreme: str = "max") -> DataFrame:
    """Whether a row has the view's greatest (or least) value."""
    return view.withColumn(name, F.col(value) == overall(view, {"max": F.max, "min": F.min}[extreme](value)))


def conditional_set(df: DataFrame, member: str, condition: Column, name: str = "SET") -> DataFrame:
    """"In" for the members whose rows together fulfil an aggregate condition, else "Out"."""
    found = fixed(df, [member], _in=condition)
    return found.withColumn(name, F.when(F.col("_in"), "In").otherwise("Out")).drop("_in")
