"""What a sheet's measure means: the first of several places that know its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.aggregates import AGGREGATES, aggregate, records, typed_total
from plinth.plans.findings import BLOCKER, Findings, Refused
from plinth.sources.naming import canonical, to_phys

RECORDS = {"numberofrecords", "count", "countofrecords"}
Calc = Callable[[], Column]


def measure(df: DataFrame, caption: str, agg: str = "sum", *, calcs: dict[str, tuple[Calc, bool]] | None = None, library: dict[str, Calc] | None = None, sheet: str = "", findings: Findings | None = None) -> Column:
    """An aggregate by its caption: the number of records; a calculation of the workbook (``calcs``: a function
    that makes it, and whether it is an aggregate already); a named measure of ``library``; a column, summed (a
    text: its least value) or by ``agg``. What none of them knows is a blocker."""
    if canonical(caption) in RECORDS and to_phys(caption) not in df.columns:
        return records()
    if caption in (calcs or {}):
        made, whole = calcs[caption]
        return made() if whole else aggregate(agg if agg.lower() in AGGREGATES else "sum", made())
    if caption in (library or {}):
        return library[caption]()
    name = to_phys(caption)
    if name not in df.columns:
        if findings is not None:
            findings.add(BLOCKER, sheet, "measure-unresolved", f"no measure {caption!r}")
        raise Refused("measure-unresolved", f"no measure {caption!r}")
    return typed_total(name, dict(df.dtypes)[name]) if agg == "sum" else aggregate(agg, F.col(name))
