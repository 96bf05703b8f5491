"""The functions of the sheets' calculations as column functions, where Spark's own differ or lack them.

Those that Spark has under the same name and meaning (abs, round, upper, ...) are used from
pyspark.sql.functions directly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.plans.findings import Refused

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
#: Short codes of date axes.
AXIS_UNITS = {"yr": "year", "qr": "quarter", "mn": "month", "tmn": "month", "wk": "week", "twk": "week", "dy": "day", "tdy": "day", "mdy": "day"}


def _unit(unit: str) -> str:
    unit = AXIS_UNITS.get(unit.lower(), unit.lower())
    if unit not in UNITS:
        raise Refused("calc-untranslated", f"no such unit of time: {unit}")
    return unit


# logic


def iif(condition: Column, yes: Column | object, no: Column | object) -> Column:
    return F.when(condition, yes).otherwise(no)


def zn(x: Column) -> Column:
    """Null as 0."""
    return F.coalesce(x, F.lit(0))


def is_date(x: Column) -> Column:
    return F.try_to_timestamp(x.cast("string")).isNotNull()


# text


def mid(s: Column, start: int, length: int | None = None) -> Column:
    return F.substring(s, start, length if length is not None else 2**31 - 1)


def find(s: Column, part: str, start: int = 1) -> Column:
    """Place of the first occurrence from ``start`` on; 0 if there is none."""
    return F.locate(part, s, start)


def split(s: Column, delimiter: str, n: int) -> Column:
    """The n-th part (from the end if negative); empty beyond the last."""
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def proper(s: Column) -> Column:
    return F.initcap(s)


def substitute(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def plus(a: Column, b: Column, *, text: bool) -> Column:
    """``+`` puts texts together and adds anything else."""
    return F.concat(a, b) if text else a + b


# dates


def date_trunc(unit: str, d: Column) -> Column:
    return F.date_trunc(_unit(unit), d).cast("timestamp_ntz")


def date_part(unit: str, d: Column) -> Column:
    """Number of the year, quarter, month, ISO week, day of month, hour, minute or second."""
    return F.date_part(F.lit(_unit(unit)), d).cast("int")


def weekday(d: Column) -> Column:
    """1 on Sundays to 7 on Saturdays."""
    return F.dayofweek(d)


def date_name(unit: str, d: Column) -> Column:
    return F.date_format(d, {"month": "MMMM", "day": "d", "year": "y"}[unit]) if unit in ("month", "day", "year") else date_part(unit, d).cast("string")


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """How many bounds of the unit lie between (a minute past midnight is a new day)."""
    unit = _unit(unit)
    months = lambda d: F.year(d) * 12 + F.month(d)
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    if unit == "quarter":
        return (F.year(end) * 4 + F.quarter(end) - F.year(start) * 4 - F.quarter(start)).cast("long")
    if unit == "month":
        return (months(end) - months(start)).cast("long")
    if unit == "day":
        return F.datediff(end, start).cast("long")
    seconds = {"week": 7 * 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    at = lambda d: F.unix_seconds(F.date_trunc(unit, d).cast("timestamp"))
    return F.floor((at(end) - at(start)) / seconds).cast("long")


def date_add(unit: str, n: int, d: Column) -> Column:
    """Months and longer keep the day, or take the month's last."""
    unit = _unit(unit)
    if unit in ("year", "quarter", "month"):
        months = n * {"year": 12, "quarter": 3, "month": 1}[unit]
        return (d + F.make_ym_interval(F.lit(0), F.lit(months))).cast("timestamp_ntz")
    seconds = n * {"week": 7 * 86400, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return (d + F.make_dt_interval(secs=F.lit(seconds))).cast("timestamp_ntz")


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def make_datetime(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.make_timestamp_ntz(y, m, d, h, mi, s)


def today(clock: Column | None = None) -> Column:
    """The date now; ``clock`` stands for now in tests and replays."""
    return F.current_date() if clock is None else clock.cast("date")


def now(clock: Column | None = None) -> Column:
    return (F.current_timestamp() if clock is None else clock).cast("timestamp_ntz")


def date_parse(fmt: str, s: Column) -> Column:
    """DATEPARSE: by a pattern of letters; null if it doesn't fit."""
    return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")


def make_time(h: Column, m: Column, s: Column) -> Column:
    """A time of day, on the day that stands for none: 30 December 1899."""
    return F.make_timestamp_ntz(F.lit(1899), F.lit(12), F.lit(30), h, m, s)


def regexp_extract(s: Column, pattern: str) -> Column:
    """What the first group matches; null if nothing does."""
    return F.when(F.regexp_like(s, F.lit(pattern)), F.regexp_extract(s, pattern, 1))


# numbers


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def log(x: Column, base: float = 10) -> Column:
    return F.log10(x) if base == 10 else F.log(base, x)


def square(x: Column) -> Column:
    return x * x


def div(a: Column, b: Column) -> Column:
    """The whole part of the quotient; null where the divisor is 0."""
    return F.try_divide(a - F.try_mod(a, b), b).cast("long")


def to_int(x: Column) -> Column:
    """The whole part; null if it is no number."""
    return x.try_cast("double").try_cast("long")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_date(x: Column) -> Column:
    return F.try_to_timestamp(x.cast("string")).cast("date")


def to_bool(x: Column) -> Column:
    return x.try_cast("boolean")


# members


def grouped(c: Column, groups: dict[str, list[str]], other: str | None = None) -> Column:
    """The group that holds a member; the rest is ``other``, or stays itself."""
    out = c if other is None else F.lit(other)
    for name, members in reversed(groups.items()):
        out = F.when(c.isin(*members), name).otherwise(out)
    return out


def in_set(c: Column, members: list[str]) -> Column:
    return F.when(c.isin(*members), "In").otherwise("Out")


def aliased(c: Column, names: dict[str, str]) -> Column:
    """Display names; keys are matched whatever their case."""
    if not names:
        return c
    pairs = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(pairs, F.lower(c)), c)


#: Postal codes of the states of the USA and the capital's district.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO",
    "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}


def state_code(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in STATES.items() for x in (k, v))), c)


def shown(c: Column, fmt: str) -> Column:
    """A value as text, by a format: pct, cur0, cur2, num0, num2, int, float, money0 or money2 (in K and M)."""
    if fmt == "pct":
        text = F.concat(F.format_number(c * 100, 1), F.lit("%"))
    elif fmt in ("cur0", "cur2"):
        text = F.concat(F.lit("$"), F.format_number(c, int(fmt[-1])))
    elif fmt in ("money0", "money2"):
        d = int(fmt[-1])
        size = F.abs(c)
        text = F.concat(F.lit("$"), F.when(size >= 1e6, F.concat(F.format_number(c / 1e6, d), F.lit("M"))).when(size >= 1e3, F.concat(F.format_number(c / 1e3, d), F.lit("K"))).otherwise(F.format_number(c, d)))
    else:
        text = F.format_number(c, {"num0": 0, "num2": 2, "int": 0, "float": 2}[fmt])
    return F.when(c.isNull() | F.isnan(c.cast("double")), "–").otherwise(text)
