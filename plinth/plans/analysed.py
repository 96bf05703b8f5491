"""What Spark's own analysis says of a formula: its columns, its aggregate, and whether two formulas are the same.

Formulas are SQL expressions. They are parsed and resolved over a table by Spark; nothing here reads SQL by itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parser(spark: SparkSession) -> Any:
    return spark._jsparkSession.sessionState().sqlParser()


def _list(items: Any) -> Iterator[Any]:
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def _resolved(df: DataFrame, *formulas: str) -> list[Any]:
    """The formulas as aggregates over the table, after analysis, without their names."""
    plan = df.agg(*(F.expr(f).alias(f"_{i}") for i, f in enumerate(formulas)))._jdf.queryExecution().analyzed()
    found = {e.name(): e for e in _list(plan.aggregateExpressions())}
    return [found[f"_{i}"].child() for i in range(len(formulas))]


def columns(df: DataFrame, formula: str) -> list[str]:
    """The columns of the table that a formula reads."""
    names = {a.name() for a in _list(_resolved(df, formula)[0].references().toSeq())}
    return [c for c in df.columns if c in names]


def fits(df: DataFrame, formula: str) -> bool:
    """Whether the table has what the formula reads."""
    try:
        df.agg(F.expr(formula))
        return True
    except AnalysisException:
        return False


def same(df: DataFrame, a: str, b: str) -> bool:
    """Whether two formulas mean the same: x + y and y + x do, x - y and y - x don't."""
    one, two = _resolved(df, a, b)
    return one.semanticEquals(two)


def aggregate(df: DataFrame, formula: str) -> tuple[str, str] | None:
    """(function, column) if a formula is one aggregate of one column; the function's name in small letters."""
    try:
        found = _resolved(df, formula)[0]
    except (AnalysisException, ParseException):
        return None
    if _kind(found) != "AggregateExpression" or found.isDistinct() or found.filter().isDefined():
        return None
    inner = list(_list(found.aggregateFunction().children()))
    while len(inner) == 1 and _kind(inner[0]) == "Cast":
        inner = list(_list(inner[0].children()))
    if len(inner) != 1 or _kind(inner[0]) != "AttributeReference":
        return None
    return found.aggregateFunction().prettyName().lower(), inner[0].name()


def unguarded(spark: SparkSession, formula: str) -> str:
    """The formula without NULLIF(x, 0) around divisors: they keep a division by 0 from failing and change no other result."""

    def text(e: Any) -> str:
        kind, parts = _kind(e), list(_list(e.children()))
        if kind == "UnresolvedFunction":
            name, args = list(_list(e.nameParts()))[-1].lower(), list(_list(e.arguments()))
            if name == "nullif" and len(args) == 2 and args[1].sql() in ("0", "0.0", "0.0D", "0BD"):
                return text(args[0])
            return f"{name}({'DISTINCT ' if e.isDistinct() else ''}{', '.join(map(text, args))})"
        if kind in ("Add", "Subtract", "Multiply", "Divide"):
            return f"({text(parts[0])} {e.symbol()} {text(parts[1])})"
        return e.sql()

    return text(_parser(spark).parseExpression(formula))


def relations(spark: SparkSession, sql: str) -> list[tuple[str, int, int]]:
    """The tables that a query names, in all of its parts: (name, first and last place in the text)."""
    found, common = {}, set()

    def walk(plan: Any) -> None:
        kind = _kind(plan)
        if kind == "UnresolvedRelation":
            at = plan.origin()
            found[at.startIndex().get(), at.stopIndex().get()] = ".".join(_list(plan.multipartIdentifier()))
        if kind == "UnresolvedWith":
            for pair in _list(plan.cteRelations()):
                common.add(pair._1().lower())
                walk(pair._2())
        for child in [*_list(plan.children()), *_list(plan.subqueries())]:
            walk(child)

    walk(_parser(spark).parsePlan(sql))
    return [(name, a, b) for (a, b), name in sorted(found.items()) if name.lower() not in common]


def renamed(spark: SparkSession, sql: str, tables: dict[str, str]) -> str:
    """The query with other names for its tables, replaced where Spark's parser found them: texts, comments, columns and aliases stay."""
    new = {k.lower(): v for k, v in tables.items()}
    for name, a, b in reversed(relations(spark, sql)):
        if name.lower() in new:
            said = sql[a : b + 1]
            alias = "" if said.lower().replace("`", "") == name.lower() else said[len(said.split()[0]) :]
            sql = f"{sql[:a]}`{new[name.lower()]}`{alias}{sql[b + 1 :]}"
    return sql
