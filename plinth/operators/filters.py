"""Filters of sheets and dashboards as conditions on columns, with literals of the columns' types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.scalar import date_part
from plinth.plans.findings import WARNING, Findings, Refused

NULL_MEMBER = "%null%"


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def members(df: DataFrame, column: str, values: Sequence[object], *, exclude: bool = False) -> Column:
    """IN or NOT IN. ``%null%``, in any case, is the member null; without it null is neither in nor out."""
    has_null = any(str(v).lower() == NULL_MEMBER for v in values)
    listed = [F.lit(v).try_cast(_kind(df, column)) for v in values if str(v).lower() != NULL_MEMBER]
    col = F.col(column)
    if exclude:
        out = ~col.isin(*listed) if listed else F.lit(True)
        return out & col.isNotNull() if has_null else out
    out = col.isin(*listed) if listed else F.lit(False)
    return out | col.isNull() if has_null else out


def between(df: DataFrame, column: str, low: object = None, high: object = None, *, part: str | None = None) -> Column:
    """A range with its ends, each optional; of a date's part if one is named. Years become ranges of dates,
    which a scan can use to skip row groups."""
    if part == "year" and not (low is None and high is None):
        first = lambda year: F.make_date(F.lit(year), F.lit(1), F.lit(1)).cast("timestamp_ntz")
        ends = ([] if low is None else [F.col(column) >= first(int(low))]) + ([] if high is None else [F.col(column) < first(int(high) + 1)])
        return reduce(Column.__and__, ends)
    col = date_part(part, F.col(column)) if part else F.col(column)
    kind = "int" if part else _kind(df, column)
    ends = [e for e in (None if low is None else col >= F.lit(low).cast(kind), None if high is None else col <= F.lit(high).cast(kind)) if e is not None]
    if not ends:
        raise Refused("filter-not-pushed", f"the range of {column} has no end")
    return reduce(Column.__and__, ends)


def part_members(column: str, part: str, values: Sequence[object], *, exclude: bool = False) -> Column:
    """Members of a date's part, given as numbers or as dates; others are left out."""
    numbers = []
    for v in values:
        text = str(v).strip("#' ")
        as_date = F.date_part(F.lit(part), F.try_to_timestamp(F.lit(text))).cast("int")
        numbers.append(F.lit(int(float(text))) if text.replace(".", "", 1).isdigit() else as_date)
    found = date_part(part, F.col(column)).isin(*numbers)
    return ~found if exclude else found


def calc(condition: Column, keep: Sequence[bool]) -> Column | None:
    """A true/false calculation: kept values true, false, or both (no filter). Null passes neither."""
    if set(keep) == {True, False}:
        return None
    return condition if True in keep else ~condition


def no_op(caption: str, values: Sequence[object] = (), domain: Sequence[object] = ()) -> bool:
    """Filters that filter nothing: actions of a dashboard, names of measures, and all members listed."""
    name = caption.strip().lower()
    return name.startswith("action (") or name in ("measure names", ":measure names") or (bool(domain) and {str(v) for v in domain} <= {str(v) for v in values})


def control(df: DataFrame, column: str, kind: str, value: object, *, part: str | None = None, sheet: str = "", findings: Findings | None = None) -> Column | None:
    """What a dashboard's control asks for: a member, a number of a date's part, or two dates; None at "All".
    The second date means its midnight: what is later on that day is out. A part that isn't known becomes a
    range of dates, and is reported."""
    if value is None or value == "All":
        return None
    if kind == "date-part" and part not in ("year", "quarter", "month", "week", "day"):
        if findings is not None:
            findings.add(WARNING, sheet, "filter-widget-unmapped", f"no part {part} of {column}: a range of dates")
        kind = "date"
    if kind == "date-part":
        return date_part(part, F.col(column)) == F.lit(value).cast("int")
    if kind == "date":
        low, high = value
        return between(df, column, low, high)
    return F.col(column) == F.lit(value).cast(_kind(df, column))


def every(conditions: Sequence[Column | None]) -> Column:
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def present(df: DataFrame, parts: dict[str, Column | None]) -> Column:
    """All conditions whose column the table has; None is a control that stands at "All"."""
    return every([c for column, c in parts.items() if column in df.columns])


@dataclass(frozen=True)
class Control:
    """A dashboard's control: None as condition stands for "All". ``sheet``: the only sheet it acts on;
    ``fields``: else only sheets that filter this field; neither: all sheets."""

    column: str
    condition: Column | None
    sheet: str | None = None
    same_field: bool = False


def for_sheet(df: DataFrame, sheet: str, saved: dict[str, Column], controls: Sequence[Control], findings: Findings) -> Column:
    """A sheet's saved filters and the dashboard's controls: a control that acts on the sheet replaces its
    saved filter of that column, at "All" too."""
    acting = [c for c in controls if (c.sheet in (None, sheet)) and (not c.same_field or c.column in saved)]
    governed = {c.column for c in acting}
    for column in sorted(governed & set(saved)):
        findings.add("INFO", sheet, "filter-governed-by-dashboard", f"{column} is set by the dashboard")
    own = [c for column, c in saved.items() if column not in governed]
    return every([*own, *(c.condition for c in acting if c.column in df.columns)])


def not_pushed(findings: Findings, sheet: str, kind: str) -> None:
    """Filters without an exact meaning here: relative dates, and aggregates of calculations."""
    code = "relative-date-not-pushed" if kind == "relative-date" else "filter-not-pushed"
    findings.add(WARNING, sheet, code, f"the {kind} filter is not applied")


def domain(df: DataFrame, column: str) -> DataFrame:
    """A control's choices."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def extent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and greatest value of several columns in one pass."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def displayed(df: DataFrame, keys: DataFrame, grain: Sequence[str], most: int = 500) -> DataFrame:
    """The rows of the keys on display; refused for more keys than a view shows."""
    shown = keys.select(*grain).distinct().limit(most + 1)
    if shown.count() > most:
        raise Refused("row-cap", f"more than {most} keys")
    return df.join(F.broadcast(shown), list(grain), "left_semi")
