"""Table calculations along an order, for views of any size: no window without partitions.

The view is sorted in ranges and written once (``laid``), each row with its range and its place there. Inside a range
values run along by a window over that range alone. What came before is a carry: each range is summed up in one row, the rows of
a pane meet, and each range gets the sum of those before it, or of all, by one small join. Ranges end in the midst of equal values
too (a hash of the row breaks ties), so a value that a third of the rows have fills no task; ranks know how many rows with a range's first value ended
the ranges before it.

Frames (WINDOW_SUM(x, -2, 0), LOOKUP(x, -1)) reach over the ends of ranges: each range gets the rows next to it, as many as
the frame is wide, from one range or from many (a halo). Carries say which ranges these are.

Nulls are passed over by sums, averages, minima and maxima; a place without rows in its frame is null. Rows that are equal in all columns are
in some order. An empty view stays empty. Sums of floating-point numbers may differ from others' in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.plans.findings import Refused
from plinth.sources.shared import written


@dataclass(frozen=True)
class Key:
    """A column to sort by. Without saying otherwise nulls come last, as in ranks."""

    column: str
    ascending: bool = True
    nulls_first: bool = False

    @property
    def order(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


def down(column: str) -> Key:
    """The greatest first, nulls last."""
    return Key(column, False)


def keys(order: Sequence[Key | str]) -> list[Key]:
    """Names mean upwards with nulls first."""
    return [k if isinstance(k, Key) else Key(k, True, True) for k in order]


@dataclass(frozen=True)
class Calc:
    kind: str
    column: str | None = None
    agg: str | None = None
    low: int | None = None
    high: int | None = None
    seed: object = None


def index() -> Calc:
    """INDEX(): places from 1."""
    return Calc("index")


def size() -> Calc:
    """SIZE(): rows of the pane."""
    return Calc("size")


def first() -> Calc:
    """FIRST(): how far the first row of the pane is (0 or less)."""
    return Calc("first")


def last() -> Calc:
    """LAST(): how far the last row of the pane is."""
    return Calc("last")


def running(agg: str, column: str) -> Calc:
    """RUNNING_SUM, _AVG, _MIN, _MAX or _COUNT."""
    return Calc("running", column, agg)


def total(agg: str, column: str) -> Calc:
    """TOTAL, or WINDOW_x over the whole pane."""
    return Calc("total", column, agg)


def previous_value(op: str, column: str, seed: float) -> Calc:
    """``x op PREVIOUS_VALUE(seed)``: from row to row, for sum, product, min or max, which don't depend on how rows are taken together."""
    if op not in ("sum", "product", "min", "max"):
        raise Refused("calc-untranslated", f"PREVIOUS_VALUE with {op}: its rows can't be taken in parts")
    return Calc("running", column, op, seed=seed)


def rank(kind: str = "rank") -> Calc:
    """RANK, RANK_DENSE, RANK_MODIFIED, RANK_PERCENTILE or RANK_UNIQUE by the first key of the order; the others break ties of RANK_UNIQUE."""
    if kind not in ("rank", "dense", "modified", "percentile", "unique"):
        raise Refused("calc-untranslated", f"no rank {kind!r}")
    return Calc("index") if kind == "unique" else Calc(kind)


def frame(agg: str, column: str, low: int | None, high: int | None) -> Calc:
    """WINDOW_SUM, _AVG, _MIN, _MAX or _COUNT of the rows from ``low`` to ``high`` (0: this one, -1: the one before; None: the end of the pane)."""
    if low is None and high is None:
        return total(agg, column)
    if low is None and high == 0:
        return running(agg, column)
    if low is None or high is None:
        raise Refused("calc-untranslated", "a frame that is open at one end ends at its row")
    if low > high:
        raise Refused("calc-untranslated", f"no frame from {low} to {high}")
    return Calc("frame", column, agg, low, high)


def lookup(column: str, offset: int) -> Calc:
    """LOOKUP(x, offset); null beyond the ends of the pane."""
    return Calc("frame", column, "only", offset, offset)


AGGREGATES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "product": F.product, "only": F.first}


@dataclass(frozen=True)
class Laid:
    """A view in its order, written: ``_range`` counts the ranges, ``_id`` grows along the order. ``several``: there is more than one."""

    rows: DataFrame
    columns: tuple[str, ...]
    within: tuple[str, ...]
    order: tuple[Key, ...]
    several: bool

    @property
    def pane(self) -> Column:
        """One value for each pane, equal for equal nulls too."""
        return F.struct(*self.within) if self.within else F.lit(0)


def laid(view: DataFrame, order: Sequence[Key | str], within: Sequence[str] = (), *, ranges: int | None = None) -> Laid:
    """``ranges``: their number, else as many as Spark finds fit."""
    by = keys(order)
    ties = F.xxhash64(*view.columns)
    sort = [*(F.col(c).asc() for c in within), *(k.order for k in by), ties]
    spread = view.repartitionByRange(ranges, *sort) if ranges else view.repartitionByRange(*sort)
    rows = written(spread.sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id()))
    return Laid(rows.withColumn("_range", F.shiftright("_id", 33)), tuple(view.columns), tuple(within), tuple(by), len(rows.inputFiles()) > 1)


def _joined(a: Column, b: Column, agg: str) -> Column:
    """The same aggregate of two sets of rows, from that of each (null: no values)."""
    if agg in ("sum", "count"):
        both = a + b
    elif agg == "product":
        both = a * b
    else:
        return F.least(a, b) if agg == "min" else F.greatest(a, b)
    return F.coalesce(both, a, b)


def _folded(rows: Column, field: str, agg: str) -> Column:
    """An aggregate over the field of an array of carries."""
    values = F.transform(rows, lambda x: x[field])
    return F.reduce(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, b: _joined(a, b, agg))


def _states(calc: Calc) -> dict[str, str]:
    """The aggregates of a range that a calculation's carries need: name to aggregate."""
    if calc.kind not in ("running", "total"):
        return {}
    return {f"_{calc.column}_{a}": a for a in (("sum", "count") if calc.agg == "avg" else (calc.agg,))}


def scan(view: DataFrame | Laid, order: Sequence[Key | str] = (), *, within: Sequence[str] = (), ranges: int | None = None, **wanted: Calc) -> DataFrame:
    """The view with a column for each of ``wanted``. ``within``: the panes' columns; a calculation starts anew in each."""
    line = view if isinstance(view, Laid) else laid(view, order, within, ranges=ranges)
    here = Window.partitionBy(*line.within, "_range")
    along, upto = here.orderBy("_id"), here.orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    calcs = list(wanted.values())
    states = {n: (c.column, a) for c in calcs for n, a in _states(c).items()}
    ranked, framed = any(c.kind in ("rank", "dense", "modified", "percentile") for c in calcs), any(c.kind == "frame" for c in calcs)
    rows = line.rows.withColumn("_pane", line.pane).withColumn("_i", F.row_number().over(along).cast("long"))
    for name, (column, agg) in states.items():
        rows = rows.withColumn(f"_upto{name}", AGGREGATES[agg](column).over(upto))
    if ranked:
        value = line.order[0]
        by = here.orderBy(value.order)
        rows = rows.withColumns({"_v": F.col(value.column), "_k": F.rank().over(by).cast("long"), "_d": F.dense_rank().over(by).cast("long")})
        rows = rows.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*line.within, "_range", "_v")))
    rows = rows.join(_carries(line, rows, states, ranked, calcs), ["_pane", "_range"]) if line.several or ranked or framed or any(c.kind in ("size", "last", "total") for c in calcs) else rows.withColumns({"_before": F.lit(0).cast("long"), **{f"_before{n}": F.lit(None) for n in states}})
    place = F.col("_before") + F.col("_i")
    rows = rows.withColumns({n: _value(c, place) for n, c in wanted.items() if c.kind != "frame"})
    if framed:
        rows = _with_frames(line, rows.withColumn("_place", place), {n: c for n, c in wanted.items() if c.kind == "frame"})
    return rows.select(*line.columns, *wanted)


def _value(c: Calc, place: Column) -> Column:
    if c.kind == "index":
        return place
    if c.kind == "size":
        return F.col("_size")
    if c.kind == "first":
        return 1 - place
    if c.kind == "last":
        return F.col("_size") - place
    if c.kind in ("running", "total"):
        of = lambda agg: _joined(F.col(f"_before_{c.column}_{agg}"), F.col(f"_upto_{c.column}_{agg}"), agg) if c.kind == "running" else F.col(f"_whole_{c.column}_{agg}")
        if c.agg == "avg":
            return F.try_divide(of("sum"), of("count"))
        found = of(c.agg)
        return found if c.seed is None else _joined(F.lit(c.seed).cast("double"), found, c.agg)
    before = F.when(F.col("_k") == 1, F.col("_equal_before")).otherwise(F.lit(0))
    rank = F.col("_before") - before + F.col("_k")
    if c.kind == "rank":
        return rank
    if c.kind == "dense":
        return F.col("_distinct_before") + F.col("_d")
    after = F.when(F.col("_v").eqNullSafe(F.col("_last")), F.col("_equal_after")).otherwise(F.lit(0))
    modified = rank + before + F.col("_same") + after - 1
    return modified if c.kind == "modified" else F.try_divide((modified - 1).cast("double"), F.col("_size") - 1)


def _carries(line: Laid, rows: DataFrame, states: dict[str, tuple[str, str]], ranked: bool, calcs: Sequence[Calc]) -> DataFrame:
    """A row for each pane and range: what the ranges before it, after it and all of them hold. The rows of a pane that meet are one for each range."""
    made = {"n": F.count(F.lit(1)), **{n: AGGREGATES[agg](column) for n, (column, agg) in states.items()}}
    if ranked:
        made |= {"d": F.max("_d"), "head": F.count_if(F.col("_k") == 1), "tail": F.count(F.lit(1)) - F.max("_k") + 1, "first": F.min_by("_v", "_id"), "last": F.max_by("_v", "_id")}
    parts = rows.groupBy("_pane", "_range").agg(*(c.alias(n) for n, c in made.items()))
    meet = parts.groupBy("_pane").agg(F.collect_list(F.struct("_range", *made)).alias("_all")).select("_pane", "_all", F.explode("_all").alias("_x"))
    x = lambda f: F.col(f"_x.{f}")
    prior = F.filter("_all", lambda y: y["_range"] < x("_range"))
    later = F.filter("_all", lambda y: y["_range"] > x("_range"))
    added = lambda rows, field: F.coalesce(_folded(rows, field, "sum"), F.lit(0).cast("long"))
    columns = {"_range": x("_range"), "_before": added(prior, "n"), "_size": added(F.col("_all"), "n")}
    for n, (_, agg) in states.items():
        columns |= {f"_before{n}": _folded(prior, n, agg), f"_whole{n}": _folded(F.col("_all"), n, agg)}
    if ranked:
        joints = F.size(F.filter(F.col("_all"), lambda y: (y["_range"] <= x("_range")) & F.exists("_all", lambda z: (z["_range"] < y["_range"]) & z["last"].eqNullSafe(y["first"]))))
        columns |= {
            "_equal_before": added(F.filter(prior, lambda y: y["last"].eqNullSafe(x("first"))), "tail"), "_equal_after": added(F.filter(later, lambda y: y["first"].eqNullSafe(x("last"))), "head"),
            "_distinct_before": added(prior, "d") - joints.cast("long"), "_last": x("last"),
        }
    if any(c.kind == "frame" for c in calcs):
        low, high = min(c.low for c in calcs if c.kind == "frame"), max(c.high for c in calcs if c.kind == "frame")
        own = columns["_before"]
        starts = F.transform("_all", lambda y: F.struct(y["_range"].alias("to"), added(F.filter("_all", lambda z: z["_range"] < y["_range"]), "n").alias("start"), y["n"].alias("n")))
        columns["_halo"] = F.filter(starts, lambda y: (y["start"] + 1 + low <= own + x("n")) & (y["start"] + y["n"] + high >= own + 1))
    return meet.select("_pane", *(c.alias(n) for n, c in columns.items()))


def _with_frames(line: Laid, rows: DataFrame, wanted: dict[str, Calc]) -> DataFrame:
    """Each row goes to its own range and to those whose frames reach it; there windows of rows give the values, of own rows only."""
    low, high = min(c.low for c in wanted.values()), max(c.high for c in wanted.values())
    reached = F.filter("_halo", lambda y: (F.col("_place") >= y["start"] + 1 + low) & (F.col("_place") <= y["start"] + y["n"] + high) | (y["to"] == F.col("_range")))
    copies = rows.withColumn("_to", F.explode(F.transform(reached, lambda y: y["to"]))).drop("_halo")
    there = Window.partitionBy(*line.within, "_to").orderBy("_place")
    found = copies.withColumns({n: AGGREGATES[c.agg](c.column).over(there.rowsBetween(c.low, c.high)) for n, c in wanted.items()})
    return found.where(F.col("_to") == F.col("_range"))
