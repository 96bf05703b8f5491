"""Whether figures from three sources agree: key by key, within what their display can show."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from plinth.functions import scan
from plinth.plans import analysed

#: From best to worst; an unknown status is the worst.
LATTICE = ("PASS", "REVIEW", "NOT_VALIDATED", "BLOCKED", "FAIL")
SOURCES = ("reference", "app", "backend")
NUMBER = "decimal(38,10)"


def tolerance(kind: str, decimals: int = 0, *, reference: Decimal | None = None, relative: float = 0.0, absolute: float | None = None) -> Decimal:
    """Half of the last digit shown; 0 for counts, ranks and keys; two digits finer for shares in percent.
    ``relative`` of the reference if that is more; ``absolute`` overrides all."""
    if absolute is not None:
        return Decimal(str(absolute))
    if kind in ("count", "int", "rank", "key"):
        return Decimal(0)
    half = Decimal(5) * Decimal(10) ** -(decimals + (3 if kind == "percent" else 1))
    return max(half, abs(reference or Decimal(0)) * Decimal(str(relative)))


def tolerance_of(kind: str, decimals: int = 0, *, reference: Column | None = None, relative: float = 0.0) -> Column:
    """``tolerance`` as a column, each row with its own reference."""
    least = F.lit(tolerance(kind, decimals)).cast(NUMBER)
    return least if reference is None or kind in ("count", "int", "rank", "key") else F.greatest(least, (F.abs(reference) * relative).cast(NUMBER))


def decimal(c: Column) -> Column:
    """A number that may be a text with thousands commas; null if it is none."""
    return F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast(NUMBER)


def worst(statuses: Sequence[str]) -> str:
    """BLOCKED if there are none."""
    if not statuses:
        return "BLOCKED"
    return LATTICE[max(LATTICE.index(s) if s in LATTICE else len(LATTICE) - 1 for s in statuses)]


def keyed(df: DataFrame, grain: Sequence[str], measures: Sequence[str], place: str | None = None) -> DataFrame:
    """A row for each key: ``_key``, ``_first`` (the measures of its first row as decimals, and its place), ``_n`` rows, ``_empty`` (a part of the
    key is null or empty). ``place``: a column that grows from row to row (``ingest.with_place``); without one the first row is the least in its measures."""
    values = F.struct(*(decimal(F.col(f"`{m}`")).alias(f"m{i}") for i, m in enumerate(measures)))
    at = values if place is None else F.col(place)
    empty = reduce(Column.__or__, [F.col(g).isNull() | (F.col(g).cast("string") == "") for g in grain], F.lit(False))
    return df.groupBy(F.struct(*grain).alias("_key")).agg(F.min_by(F.struct(values.alias("values"), at.alias("place")), at).alias("_first"), F.count(F.lit(1)).alias("_n"), F.max(empty).alias("_empty"))


def problems(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """One row: ``duplicates``, keys that occur more than once, and ``nulls``, rows with a null or empty key
    part."""
    return keyed(df, grain, []).agg(F.count_if(F.col("_n") > 1).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("_empty"), F.col("_n"))), F.lit(0)).alias("nulls"))


def first_rows(df: DataFrame, grain: Sequence[str], place: str) -> DataFrame:
    """Of the rows with one key the first, by its place, with all of its columns."""
    rest = [c for c in df.columns if c not in grain]
    found = df.groupBy(F.struct(*grain).alias("_key")).agg(F.min_by(F.struct(*rest), F.col(place)).alias("_row"))
    return found.select(*(F.col("_key")[g].alias(g) for g in grain), *(F.col("_row")[c].alias(c) for c in rest))


def order_match(one: DataFrame, two: DataFrame, grain: Sequence[str], order: str) -> DataFrame:
    """One row: ``order_match``, whether both have the same keys in the same order of their first rows.
    ``order``: the column with a row's place."""
    first = lambda df, n: df.groupBy(F.struct(*grain).alias("_key")).agg(F.min(order).alias(n))
    both = first(one, "_a").join(first(two, "_b"), "_key", "full_outer")
    line = scan.scan(both.select("_a", "_b"), [scan.Key("_a")], _before=scan.lookup("_b", -1))
    return line.agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_before") >= F.col("_b"))) == 0).alias("order_match"))


def _side_by_side(sources: dict[str, DataFrame], grain: Sequence[str], measures: Sequence[str], place: str | None) -> DataFrame:
    """A row for each key with a column for each source: its first row, number of rows and whether the key is empty, null where it lacks the key. The rows of all
    sources are aggregated together, in one exchange with a row for each key that a task has. Where the place is a number its states are of fixed size, so they are
    hashed, not sorted."""
    rows, kinds, made, sides = [], {g: next(iter(sources.values())).schema[g].dataType for g in grain}, [], []
    fields = [f"m{i}" for i in range(len(measures))]
    for s, df in sources.items():
        values = F.struct(*(decimal(F.col(f"`{m}`")).alias(n) for m, n in zip(measures, fields, strict=True)))
        at = values if place is None else F.col(place)
        empty = reduce(Column.__or__, [F.col(g).isNull() | (F.col(g).cast("string") == "") for g in grain], F.lit(False))
        df = df.withColumns({g: F.col(g).cast(k) for g, k in kinds.items()})
        rows.append(df.select(F.struct(*grain).alias("_key"), F.lit(s).alias("_source"), values.alias("_values"), at.alias(f"_at_{s}"), empty.alias("_empty")))
        mine = F.col("_source") == s
        if place is not None and isinstance(df.schema[place].dataType, NumericType):
            made += [F.min_by(F.col("_values")[n], F.col(f"_at_{s}")).alias(f"_{n}_{s}") for n in fields]
            first = F.struct(*(F.col(f"_{n}_{s}").alias(n) for n in fields))
        else:
            made.append(F.min_by("_values", F.col(f"_at_{s}")).alias(f"_values_{s}"))
            first = F.col(f"_values_{s}")
        made += [F.count_if(mine).alias(f"_n_{s}"), F.max(F.when(mine, F.col("_empty"))).alias(f"_empty_{s}")]
        sides.append(F.when(F.col(f"_n_{s}") > 0, F.struct(first.alias("values"), F.col(f"_n_{s}").alias("n"), F.col(f"_empty_{s}").alias("empty"))).alias(s))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("_key").agg(*made).select("_key", *sides)


def _cells(grid: DataFrame, have: Sequence[str], measures: Sequence[str], tolerances: dict[str, Decimal]) -> list[Column]:
    """Of each measure: the values of the sources, their differences, and what that makes."""
    everywhere = reduce(Column.__and__, [F.col(s).isNotNull() for s in have])
    cells = []
    for i, m in enumerate(measures):
        value = {s: F.col(s)["values"][f"m{i}"] if s in have else F.lit(None).cast(NUMBER) for s in SOURCES}
        tol = F.lit(tolerances[m]).cast(NUMBER)
        pairs = {f"{a}_{b}_diff": F.abs(value[a] - value[b]) for a, b in (("reference", "app"), ("app", "backend"), ("reference", "backend"))}
        bad = reduce(Column.__or__, [F.coalesce(d > tol, F.lit(False)) for d in pairs.values()], ~everywhere)
        none = reduce(Column.__and__, [d.isNull() for d in pairs.values()])
        made = F.when(bad, "FAIL").when(none, "BLOCKED").otherwise("PASS")
        cells.append(F.struct(F.lit(m).alias("measure"), *(v.alias(s) for s, v in value.items()), *(d.alias(n) for n, d in pairs.items()), tol.alias("tolerance"), made.alias("status")))
    return cells


def compare(sources: dict[str, DataFrame], grain: Sequence[str], measures: Sequence[str], tolerances: dict[str, Decimal], *, place: str | None = None) -> DataFrame:
    """A row for each key and measure: the value in each source (of SOURCES, some may lack), the differences of
    each pair, and PASS, FAIL or, without any pair, BLOCKED. A key that a source lacks fails. Of rows with one
    key the first counts, by ``place`` if there is such a column in all sources; ``problems`` tells of them."""
    have = {s: sources[s] for s in SOURCES if s in sources}
    grid = _side_by_side(have, grain, measures, place)
    rows = grid.select("_key", F.explode(F.array(*_cells(grid, list(have), measures, tolerances))).alias("x"))
    return rows.select(*(F.col("_key")[g].alias(g) for g in grain), "x.*")


def status(cells: DataFrame) -> DataFrame:
    """One row: the worst ``status`` of a comparison."""
    place = F.array_position(F.array(*map(F.lit, LATTICE)), F.col("status")).cast("int")
    rank = F.coalesce(F.max(F.when(place > 0, place).otherwise(len(LATTICE))), F.lit(LATTICE.index("BLOCKED") + 1))
    return cells.agg(F.element_at(F.array(*map(F.lit, LATTICE)), rank).alias("status"))


def chart_status(sources: dict[str, DataFrame], grain: Sequence[str], measures: Sequence[str], tolerances: dict[str, Decimal], *, order: str | None = None) -> str:
    """A chart of which a source is missing is BLOCKED; one whose keys repeat or are empty FAILs, and one whose
    keys come in another order in the app than in the reference (by the column ``order``, if there is one). One aggregation gives all but the order."""
    if not grain or not measures or set(sources) != set(SOURCES):
        return "BLOCKED"
    grid = _side_by_side({s: sources[s] for s in SOURCES}, grain, measures, order)
    wrong = reduce(Column.__or__, [F.coalesce((F.col(s)["n"] > 1) | F.col(s)["empty"], F.lit(False)) for s in SOURCES])
    rank = F.array_max(F.transform(F.array(*_cells(grid, SOURCES, measures, tolerances)), lambda c: F.array_position(F.array(*map(F.lit, LATTICE)), c["status"])))
    found = grid.agg(F.coalesce(F.max(wrong), F.lit(False)).alias("wrong"), F.max(rank).alias("rank")).first()
    if found["wrong"] or (order and not order_match(sources["reference"], sources["app"], grain, order).first()["order_match"]):
        return "FAIL"
    return "BLOCKED" if found["rank"] is None else LATTICE[found["rank"] - 1]


def roll_up(charts: dict[str, dict[str, str]], visual: dict[str, str] | None = None) -> dict[str, str]:
    """Worst chart of each dashboard, and of all under "workbook". A dashboard's ``visual`` comparison counts
    like a chart, unless it is BLOCKED: that it couldn't be made says nothing of the figures."""
    seen = {d: [v] for d, v in (visual or {}).items() if v != "BLOCKED"}
    out = {d: worst([*c.values(), *seen.get(d, [])]) for d, c in charts.items()}
    return out | {"workbook": worst(list(out.values()))}


def rolled_up(charts: DataFrame) -> DataFrame:
    """``charts``: (dashboard, chart, status). The worst status of each dashboard, and of all as "workbook"."""
    place = F.array_position(F.array(*map(F.lit, LATTICE)), F.col("status")).cast("int")
    worst = charts.groupBy("dashboard").agg(F.max(F.when(place > 0, place).otherwise(len(LATTICE))).alias("rank"))
    both = worst.unionAll(worst.agg(F.lit("workbook").alias("dashboard"), F.coalesce(F.max("rank"), F.lit(LATTICE.index("BLOCKED") + 1)).alias("rank")))
    return both.select("dashboard", F.element_at(F.array(*map(F.lit, LATTICE)), F.col("rank")).alias("status"))


def parity(app: DataFrame, source: DataFrame, measures: Sequence[str], relative: float = 0.01) -> DataFrame:
    """Totals by two ways: a row for each measure with PASS within ``relative`` of the source, else BUG; and
    the numbers of rows, which must be equal."""
    total = lambda df, side: df.agg(*(F.sum(m).cast("double").alias(f"{m}_{side}") for m in measures), F.count(F.lit(1)).cast("double").alias(f"ROWS_{side}"))
    a, b = total(app, "app"), total(source, "source")
    one = a.withColumns({c: b.select(c).scalar() for c in b.columns})
    rows = []
    for m in [*measures, "ROWS"]:
        x, y = F.col(f"{m}_app"), F.col(f"{m}_source")
        near = F.abs(x - y) <= F.abs(y) * (0 if m == "ROWS" else relative)
        rows.append(F.struct(F.lit(m).alias("measure"), x.alias("app"), y.alias("source"), F.when(x.eqNullSafe(y) | near, "PASS").otherwise("BUG").alias("verdict")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def gate(df: DataFrame, metrics: dict[str, Column], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """All metrics in one pass: a row for each with PASS inside its known bounds, BUG outside or if it is null,
    EXECUTED if no bounds are known."""
    one = df.agg(*(m.cast("double").alias(n) for n, m in metrics.items()))
    rows = []
    for n in metrics:
        low, high = bounds.get(n, (None, None))
        known = F.lit("EXECUTED") if low is None else F.when(F.col(n).between(low, high), "PASS").otherwise("BUG")
        rows.append(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.when(F.col(n).isNull(), "BUG").otherwise(known).alias("verdict")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def partitions(df: DataFrame, dims: Sequence[str] | None = None) -> bool:
    """Whether the dimensions tell the rows apart, so that parts may be added up. Without ``dims`` they are the columns that are no numbers; an export
    by Measure Names has rows of different measures, which are no parts of anything."""
    if dims is None:
        dims = [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType)]
    if not dims or any(d.strip(" :").lower() == "measure names" for d in dims):
        return False
    return df.groupBy(*(F.col(f"`{d}`") for d in dims)).count().where("count > 1").isEmpty()


def restricts(total: float | None, filtered: float | None, *, members: float | None = None, n: float | None = None) -> bool:
    """A filter can't add rows, and a set of N leaves ``n`` members at most; what isn't known fails."""
    if n is not None and (members is None or members > n):
        return False
    return total is not None and filtered is not None and filtered <= total


def normal_header(header: str) -> str:
    """What a column's heading and a metric's caption share: what stands inside the brackets of an aggregate's call, in small letters and with single blanks."""
    call, opened, inside = header.strip().partition("(")
    wrapped = opened and inside.endswith(")") and call.replace(" ", "").isalpha()
    return " ".join((inside[:-1] if wrapped else header).split()).lower()


def pure_sum(df: DataFrame, formula: str | None) -> bool:
    """Whether a formula is, after analysis over the table, the SUM of one column: the only one whose parts may be added up."""
    found = analysed.aggregate(df, formula) if formula else None
    return found is not None and found[0] == "sum"


def single_row_truth(view: DataFrame, metrics: dict[str, str]) -> dict[str, Decimal]:
    """Known values from an exported view: those of its only row, by heading. ``metrics``: captions by name. A
    view of several rows is a breakdown, from which no total is made."""
    rows = view.limit(2).collect()
    if len(rows) != 1:
        return {}
    columns = {}
    for c in view.columns:
        columns.setdefault(normal_header(c), c)
    values = {n: displayed_number(str(rows[0][columns[normal_header(c)]]).replace("%", "")) for n, c in metrics.items() if normal_header(c) in columns}
    return {n: v for n, v in values.items() if v is not None}


def formula_class(df: DataFrame, a: str, b: str, *, grain_only: bool = False) -> str:
    """Of two formulas over a table: EXACT if their texts are the same but for blanks and case; SEMANTICALLY_EQUIVALENT if Spark's analysis says that they
    mean the same, guards against 0 left out (``grain_only``: EQUIVALENT_AT_CURRENT_GRAIN, they do so in this view); else MISMATCH. Order and
    operands count."""
    if " ".join(a.split()).upper() == " ".join(b.split()).upper():
        return "EXACT"
    spark = df.sparkSession
    try:
        equal = analysed.same(df, analysed.unguarded(spark, a), analysed.unguarded(spark, b))
    except (AnalysisException, ParseException):
        return "MISMATCH"
    return "MISMATCH" if not equal else "EQUIVALENT_AT_CURRENT_GRAIN" if grain_only else "SEMANTICALLY_EQUIVALENT"


def crosstab_sheet(header: Sequence[str], sheets: dict[str, Sequence[str]]) -> str | None:
    """The one sheet with exactly these columns."""
    found = [s for s, columns in sheets.items() if set(columns) == set(header)]
    return found[0] if len(found) == 1 else None


def displayed_number(text: str) -> Decimal | None:
    """What a figure on display says: percents as shares, K and M as thousands and millions."""
    t = text.strip().replace(",", "").replace("$", "")
    scale = Decimal(1)
    for sign, size in (("%", Decimal("0.01")), ("K", Decimal(1000)), ("M", Decimal(1000000)), ("B", Decimal(1000000000))):
        if t.upper().endswith(sign):
            t, scale = t[:-1], size
    try:
        return Decimal(t) * scale
    except ArithmeticError:
        return None


class Registry:
    """Evidence of charts by name; the first capture counts, another one under its name is refused."""

    def __init__(self) -> None:
        self.charts: dict[str, DataFrame] = {}

    def add(self, name: str, rows: DataFrame) -> bool:
        from plinth.sources.naming import canonical

        if canonical(name) in self.charts:
            return False
        self.charts[canonical(name)] = rows
        return True
