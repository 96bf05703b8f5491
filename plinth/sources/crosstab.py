"""Crosstabs that were exported for people, back into rows: measures by name in rows, members in columns, figures as they are shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.plans.findings import Refused

#: What the columns of an export by measure are called.
MEASURE_NAMES, MEASURE_VALUES = "Measure Names", "Measure Values"
#: How figures on display end.
SCALES = {"K": 1e3, "M": 1e6, "B": 1e9, "%": 0.01}
MOST_MEASURES = 500


def figure(c: Column) -> Column:
    """A figure on display as a number: thousands commas, $, K, M, B, percent; in brackets negative. Null if it is none."""
    text = F.upper(F.trim(c))
    negative = text.startswith("(") & text.endswith(")")
    bare = F.translate(text, "$, ()", "")
    scale = F.lit(1.0)
    for sign, size in SCALES.items():
        scale = F.when(bare.endswith(sign), size).otherwise(scale)
    value = F.regexp_replace(bare, "[KMB%]$", "").try_cast("double") * scale
    return F.when(negative, -value).otherwise(value)


def settled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of texts become numbers if all that they hold are figures; one pass decides for all."""
    counts = df.agg(*(F.count_if((F.col(f"`{c}`").isNotNull()) & figure(F.col(f"`{c}`")).isNull()).alias(str(i)) for i, c in enumerate(columns)))
    bad = counts.first()
    return df.withColumns({c: figure(F.col(f"`{c}`")) for i, c in enumerate(columns) if not bad[i]})


def from_measure_names(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """An export with a row for each measure: one row for each set of the other columns and a column for each measure, typed for itself. A measure
    that occurs twice for the same members is refused: there is no telling which one counts."""
    dims = [c for c in df.columns if c not in (MEASURE_NAMES, MEASURE_VALUES)]
    if names is None:
        names = sorted(r[0] for r in df.select(MEASURE_NAMES).where(F.col(f"`{MEASURE_NAMES}`").isNotNull()).distinct().limit(MOST_MEASURES + 1).collect())
        if len(names) > MOST_MEASURES:
            raise Refused("row-cap", f"more than {MOST_MEASURES} measures")
    value, key = F.col(f"`{MEASURE_VALUES}`"), F.col(f"`{MEASURE_NAMES}`")
    wide = df.groupBy(*dims).agg(*(F.max(F.when(key == n, value)).alias(n) for n in names), F.array_max(F.array(F.lit(0).cast("long"), *(F.count_if(key == n) for n in names))).alias("_n"))
    if not wide.where("_n > 1").isEmpty():
        raise Refused("measure-unresolved", "a measure occurs twice for the same members")
    return settled(wide.drop("_n"), list(names))


def from_members(df: DataFrame, dims: Sequence[str], member: str, value: str) -> DataFrame:
    """An export with a column for each member: a row for each member, figures as numbers. Empty cells give no row."""
    rest = [c for c in df.columns if c not in dims]
    long = df.select(*dims, *(F.col(f"`{c}`").cast("string").alias(c) for c in rest)).unpivot(list(dims), [F.col(f"`{c}`") for c in rest], member, value)
    return long.where(F.col(value).isNotNull()).withColumn(value, figure(F.col(value)))


def to_members(df: DataFrame, dims: Sequence[str], member: str, value: str) -> DataFrame:
    """Rows as such an export, to check one by the way back."""
    return df.groupBy(*dims).pivot(member).agg(F.max(value))
