"""The kinds of sheets, each a lazy DataFrame over a (flattened, filtered) table.

Measures are aggregate columns by name, dimensions names of columns. Every order has the dimension as a tie-break,
so limits and ranks are the same in every run. Values that relate to the whole view are computed on its
grouped rows. Kinds with places or running values (mbar, rank_table, pctbar, manual orders) write their view when they are built."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.lod import indexed, overall, refuse, share_of
from plinth.functions.scalar import date_part, date_trunc, state_code
from plinth.functions.scan import Key, down, running, scan, total
from plinth.plans.findings import APPEARANCE, BLOCKER, COSMETIC, INFO, WARNING, Findings, Refused

Measures = dict[str, Column]
#: What a sheet of a kind shows at most.
BARS, STRIP, CELLS, LINES, CATEGORIES, PANELS, MEMBERS, EVIDENCE = 30, 50, 200, 5000, 40, 8, 200, 30


def _agg(df: DataFrame, keys: Sequence[str], measures: Measures) -> DataFrame:
    return df.groupBy(*keys).agg(*(m.alias(n) for n, m in measures.items()))


def kpi(df: DataFrame, measures: Measures) -> DataFrame:
    """One row: all measures in one pass."""
    return df.agg(*(m.alias(n) for n, m in measures.items()))


def delta(view: DataFrame, value: str, before: str, name: str = "DELTA") -> DataFrame:
    """The signed change between two figures, null where the former is 0."""
    return view.withColumn(name, F.try_divide(F.col(value) - F.col(before), F.abs(before)))


def mbar(df: DataFrame, dim: str, measures: Measures, *, by: str | None = None, ascending: bool = False) -> DataFrame:
    """A bar for each measure side by side, rows in the order of one of them."""
    view = _agg(df, [dim], measures)
    by = by or next(iter(measures))
    return indexed(view, [Key(by, ascending), dim], "POS")


def bar(df: DataFrame, dim: str, value: Column, *, color: Column | None = None, n: int = BARS) -> DataFrame:
    """The N greatest; ``color``: a further measure (a bucket of aggregates, say)."""
    view = _agg(df, [dim], {"VAL": value} | ({} if color is None else {"C": color}))
    return view.orderBy(F.desc_nulls_last("VAL"), dim).limit(n)


def stacked(df: DataFrame, dim: str, color: str, value: Column) -> DataFrame:
    """Parts of each bar with where they start and the middle for their label."""
    view = _agg(df, [dim, color], {"VAL": value})
    upto = F.sum("VAL").over(Window.partitionBy(dim).orderBy(color).rowsBetween(Window.unboundedPreceding, 0))
    return view.withColumn("X1", upto).withColumn("X0", F.col("X1") - F.col("VAL")).withColumn("MID", F.col("X1") - F.col("VAL") / 2)


def line(df: DataFrame, date: str, value: Column, *, unit: str = "month", panel: str | None = None, flag: Column | None = None) -> DataFrame:
    """A value over time, in panels or split by a flag of rows."""
    df = df.withColumn("T", date_trunc(unit, F.col(date)))
    keys = ["T"] + ([panel] if panel else [])
    if flag is not None:
        df, keys = df.withColumn("FLAG", flag), [*keys, "FLAG"]
    return _agg(df, keys, {"VAL": value})


area = line


def panels(view: DataFrame, panel: str, sheet: str, findings: Findings) -> DataFrame:
    """Of a view with too many panels: one total of each time and panel, for lines in colours."""
    if view.select(panel).distinct().limit(PANELS + 1).count() <= PANELS:
        return view
    findings.add(INFO, sheet, "panel-as-color", f"more than {PANELS} of {panel}")
    return view.groupBy("T", panel).agg(F.sum("VAL").alias("VAL"))


def first_panels(view: DataFrame, panel: str, sheet: str, findings: Findings) -> DataFrame:
    findings.add(INFO, sheet, "panel-capped", f"the first {PANELS} of {panel}")
    return view.join(F.broadcast(view.select(panel).distinct().orderBy(panel).limit(PANELS)), panel, "left_semi")


def scatter(df: DataFrame, grain: Sequence[str], x: Column, y: Column, *, more: Measures | None = None) -> DataFrame:
    return _agg(df, grain, {"X": x, "Y": y} | (more or {}))


def strip(df: DataFrame, dim: str, x: Column) -> DataFrame:
    """A strip of dots, the N greatest."""
    return _agg(df, [dim], {"X": x}).orderBy(F.desc_nulls_last("X"), dim).limit(STRIP)


def trend(view: DataFrame) -> DataFrame:
    """The line of least squares through a scatter's points."""
    return view.agg(F.regr_slope("Y", "X").alias("SLOPE"), F.regr_intercept("Y", "X").alias("INTERCEPT"))


def reference_line(view: DataFrame, value: str, kind: str, parameter: float | None = None) -> DataFrame:
    """Average, median, min, max or sum of a view's column; or the value of a parameter."""
    if kind == "parameter":
        return view.sparkSession.createDataFrame([(parameter,)], "REF double")
    f = {"average": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "total": F.sum}[kind]
    return view.agg(f(value).alias("REF"))


def heatmap(df: DataFrame, rows: Sequence[str], date: str, part: str, value: Column) -> DataFrame:
    return _agg(df.withColumn("X", date_part(part, F.col(date))), [*rows, "X"], {"VAL": value})


def circle(df: DataFrame, facet: str, rows: Sequence[str], detail: str, x: Column, *, color: Column | None = None) -> DataFrame:
    return _agg(df, [facet, *rows, detail], {"X": x} | ({} if color is None else {"C": color}))


def rank_table(df: DataFrame, dim: str, measures: Measures, *, by: Column | None = None) -> DataFrame:
    """All rows in the order of a value (else the first measure), nulls last, with their places."""
    view = _agg(df, [dim], measures | ({} if by is None else {"VORD": by}))
    return indexed(view, [down("VORD" if by is not None else next(iter(measures))), dim], "RANK")


def pctbar(df: DataFrame, seg: str) -> DataFrame:
    """Each segment's share of the rows, laid end to end from the greatest."""
    line = scan(_agg(df, [seg], {"N": F.count(F.lit(1))}), [down("N"), seg], _upto=running("sum", "N"), _whole=total("sum", "N"))
    view = line.withColumns({"PCT": F.col("N") / F.col("_whole"), "X1": F.col("_upto") / F.col("_whole")}).drop("_upto", "_whole")
    return view.withColumn("X0", F.col("X1") - F.col("PCT")).withColumn("MID", F.col("X1") - F.col("PCT") / 2)


def _largest(view: DataFrame, category: str, sheet: str, findings: Findings) -> DataFrame:
    """The categories with the most rows of the view, if there are too many."""
    findings.add(INFO, sheet, "category-cap", f"the {CATEGORIES} largest of {category}", lambda: view.select(category).distinct().limit(CATEGORIES + 1).count() > CATEGORIES)
    # all columns are named in the order (categories are distinct, so in vain) and the join is an inner one on equal
    # or null categories, so that neither use of the view is pruned or filtered and both read one exchange
    rest = [c for c in view.columns if c != category]
    kept = view.groupBy(F.col(category).alias("_kept")).agg(F.count(F.lit(1)).alias("_n"), *(F.max(c).alias(f"_m{i}") for i, c in enumerate(rest)))
    kept = kept.orderBy(F.desc("_n"), "_kept", *(f"_m{i}" for i in range(len(rest)))).limit(CATEGORIES).select("_kept")
    return view.join(F.broadcast(kept), F.col(category).eqNullSafe(F.col("_kept"))).drop("_kept")


def _capped(view: DataFrame, order: Sequence[str], sheet: str, findings: Findings) -> DataFrame:
    findings.add(INFO, sheet, "row-cap", f"the first {LINES} rows", lambda: view.limit(LINES + 1).count() > LINES)
    return view.orderBy(*order).limit(LINES)


def dots(df: DataFrame, y: str, date: str, size: Column, sheet: str, findings: Findings, *, unit: str = "month", color: str | None = None) -> DataFrame:
    keys = [y, "T"] + ([color] if color else [])
    return _capped(_largest(_agg(df.withColumn("T", date_trunc(unit, F.col(date))), keys, {"SZ": size}), y, sheet, findings), keys, sheet, findings)


def dual(df: DataFrame, date: str, first: Column, second: Column | None = None, *, unit: str = "month") -> DataFrame:
    """Two measures over time on two axes; one of them alone if the other can't be had. Years are numbers."""
    t = F.year(date) if unit == "year" else date_trunc(unit, F.col(date))
    return _agg(df.withColumn("T", t), ["T"], {"V0": first} | ({} if second is None else {"V1": second}))


def pie(df: DataFrame, seg: str, value: Column) -> DataFrame:
    view = _agg(df, [seg], {"VAL": value})
    return view.withColumn("TOTAL", overall(view, F.sum("VAL")))


def dtbar(df: DataFrame, date: str, value: Column, *, unit: str = "quarter", flag: Column | None = None) -> DataFrame:
    return line(df, date, value, unit=unit, flag=flag)


def treemap(df: DataFrame, label: str, value: Column, *, color: Column | None = None) -> DataFrame:
    """Positive values and their share of the whole."""
    view = _agg(df, [label], {"V": value} | ({} if color is None else {"C": color})).where("V > 0")
    return share_of(view, "V", "SHARE")


def bubbles(df: DataFrame, label: str, value: Column, *, color: Column | None = None) -> DataFrame:
    """The greatest, with radii by the root of the value, 10 for the greatest."""
    view = _agg(df, [label], {"V": value} | ({} if color is None else {"C": color})).where("V > 0").orderBy(F.desc("V"), label).limit(CATEGORIES)
    return view.withColumn("R", F.sqrt(F.col("V") / overall(view, F.max("V"))) * 10)


def strips(df: DataFrame, dim: str, measures: Measures) -> DataFrame:
    """A strip for each measure: all of them in one pass, then one row for each."""
    view = _agg(df, [dim], measures)
    return view.select(dim, F.explode(F.array(*(F.struct(F.lit(n).alias("MEASURE"), F.col(n).cast("double").alias("V")) for n in measures))).alias("x")).select(dim, "x.*")


def gantt(df: DataFrame, y: str, start: str, duration: Column, sheet: str, findings: Findings, *, unit: str = "day") -> DataFrame:
    """Spans of days, 0.35 of one at least so that they can be seen."""
    view = _agg(df.withColumn("START", date_trunc(unit, F.col(start))), [y, "START"], {"DUR": duration})
    view = view.withColumn("END", (F.col("START") + F.make_dt_interval(secs=(F.greatest("DUR", F.lit(0.35)) * 86400).cast("decimal(18,6)"))).cast("timestamp_ntz"))
    return _capped(_largest(view, y, sheet, findings), [y, "START"], sheet, findings)


def table(df: DataFrame, dims: Sequence[str], measures: Measures, *, by: str | None = None, ascending: bool = False, n: int = CELLS) -> DataFrame:
    """Sorted, then limited; by the first measure unless a column is named."""
    by = by or next(iter(measures), dims[0])
    return _agg(df, dims, measures).orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by), *dims).limit(n)


def geo_map(df: DataFrame, geo: str, value: Column, sheet: str, findings: Findings, *, states: bool = False) -> DataFrame:
    """A value by place (a text: its greatest); of states those with a code."""
    if geo not in df.columns:
        findings.add(BLOCKER, sheet, "geo-missing", f"{geo} is not there")
        raise Refused("geo-missing", f"{geo} is not there")
    view = _agg(df, [geo], {"C": value})
    if not states:
        return view
    view = view.withColumn("CODE", state_code(F.col(geo)))
    unmapped = view.where(F.col("CODE").isNull())
    findings.add(INFO, sheet, "geo-unmapped", f"members of {geo} without a code are left out", lambda: not unmapped.isEmpty())
    return view.where(F.col("CODE").isNotNull())


def member_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns).limit(MEMBERS)


def manual_order(view: DataFrame, dim: str, members: Sequence[str]) -> DataFrame:
    """Listed members first, in that order, then the rest."""
    place = F.array_position(F.array(*map(F.lit, members)), F.col(dim))
    return indexed(view.withColumn("_listed", F.when(place > 0, place).otherwise(2**31)), ["_listed", dim], "POS").drop("_listed")


def evidence(view: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return view.orderBy(*order).limit(EVIDENCE)


def drill(dims: Sequence[str], hierarchy: Sequence[str], level: int) -> list[str]:
    """The dimensions with the hierarchy's member replaced by another level, unless that is there already."""
    target = hierarchy[level]
    if target in dims:
        return list(dims)
    return [target if d in hierarchy else d for d in dims]


KINDS = {
    "kpi": kpi, "mbar": mbar, "bar": bar, "stacked": stacked, "line": line, "area": area, "scatter": scatter, "strip": strip, "heatmap": heatmap, "circle": circle, "rank_table": rank_table, "pctbar": pctbar,
    "dots": dots, "dual": dual, "pie": pie, "dtbar": dtbar, "treemap": treemap, "bubbles": bubbles, "strips": strips, "gantt": gantt, "table": table, "map": geo_map, "members": member_list,
}


#: What a sheet may have that is not shown: severity, code and message.
NOT_SHOWN = {
    "subtotals": (APPEARANCE, "subtotals-dropped", "rows of details alone, no subtotals"), "forecast": (APPEARANCE, "forecast-dropped", "the past alone, no forecast"),
    "axis": (APPEARANCE, "axis-scale", "the axis has its own scale"), "images": (APPEARANCE, "image-marks", "marks are no images"),
    "tooltip": (COSMETIC, "viz-in-tooltip", "no sheet inside a tooltip"), "devices": (INFO, "device-layouts", "one layout for all devices"),
    "story": (WARNING, "story-unsupported", "no stories"), "blend": (WARNING, "blend-partial", "the first source alone"), "order": (WARNING, "window-ordering", "the view's order is that of its first dimension"),
}


def checked(df: DataFrame, kind: str, columns: Sequence[str], sheet: str, findings: Findings, *, window_measure: bool = False, window_dims: Sequence[str] = (), calls: Sequence[str] = (), has: Sequence[str] = ()) -> list[str]:
    """Before a sheet is built: its kind, its columns, the table calculations it ``calls``, whether it can show a
    measure of the whole view, and what else it ``has``. Returns its columns without ``window_dims`` (INDEX or
    RANK of the view as a dimension), which no kind groups by, and for tables without those that aren't there."""
    if kind not in KINDS:
        raise Refused("non-data-sheet", f"no sheets of kind {kind}")
    for name in calls:
        refuse(name)
    for c in columns:
        if c not in df.columns and c not in window_dims:
            if kind == "table":
                findings.add(WARNING, sheet, "dim-skipped", f"{c} is not there")
                continue
            findings.add(BLOCKER, sheet, "measure-unresolved", f"{c} is not there")
            raise Refused("measure-unresolved", f"{c} is not there")
    if window_measure and kind not in ("bar", "scatter"):
        findings.add(WARNING, sheet, "window-in-kpi", f"{kind} sheets show no measures of the whole view")
    if dropped := [c for c in columns if c in window_dims]:
        findings.add(WARNING, sheet, "window-dim-dropped", f"{', '.join(sorted(dropped))} not applied to {kind}")
    for x in has:
        findings.add(NOT_SHOWN[x][0], sheet, *NOT_SHOWN[x][1:])
    return [c for c in columns if c not in window_dims and c in df.columns]


def colour(df: DataFrame, find: Callable[[], Column], caption: str, sheet: str, findings: Findings) -> Column | None:
    """A measure for colour; a sheet is shown without one that nothing knows."""
    try:
        return find()
    except Refused:
        findings.add(WARNING, sheet, "color-unresolved", f"no {caption} to colour by")
        return None


def computable(df: DataFrame, measures: Measures, sheet: str, findings: Findings) -> Measures:
    """The measures that the table can give; one whose columns or types don't fit is reported and left out."""
    out = {}
    for name, m in measures.items():
        try:
            df.agg(m)
            out[name] = m
        except AnalysisException as e:
            findings.add(BLOCKER, sheet, "measure-query-failed", f"{name}: {e.getCondition()}")
    return out


def built(df: DataFrame, kind: str, dims: Sequence[str], sheet: str, findings: Findings, *args: object, calls: Sequence[str] = (), window_dims: Sequence[str] = (), window_measure: bool = False, has: Sequence[str] = (), **options: object) -> DataFrame:
    """A sheet of a kind, after ``checked``, with the finding that it is empty if it is. ``dims`` are its
    dimensions, as a list for kinds that take several; the rest goes to the kind's function."""
    kept = checked(df, kind, dims, sheet, findings, window_measure=window_measure, window_dims=window_dims, calls=calls, has=has)
    lists = kind in ("scatter", "table", "members")
    view = KINDS[kind](df, *([kept] if lists else kept), *args, **options)
    findings.add(WARNING, sheet, "empty-result", "no rows: see the filters", view.isEmpty)
    return view
