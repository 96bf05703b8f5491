"""Tables with relationships: one fact, dimensions joined outwards along a tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plinth.plans.findings import Refused
from plinth.sources.naming import to_phys


@dataclass(frozen=True)
class Edge:
    """``parent.key = child.child_key``; the child is unique on its key."""

    parent: str
    key: str
    child: str
    child_key: str


@dataclass(frozen=True)
class JoinPlan:
    shape: str  # single, star or snowflake
    root: str
    edges: tuple[Edge, ...]  # parents before children


def join_plan(tables: Sequence[str], edges: Sequence[Edge]) -> JoinPlan:
    """The tree, breadth first; anything else is refused with the reason."""
    children = [e.child for e in edges]
    roots = [t for t in tables if t not in children]
    if len(roots) != 1:
        raise Refused("datasource-unmapped", f"multi_fact: {roots or 'no'} tables are no table's dimension")
    if len(edges) != len(tables) - 1 or len(set(children)) != len(children):
        raise Refused("datasource-unmapped", f"non_star: {len(edges)} relationships among {len(tables)} tables")
    order, reached = [], [roots[0]]
    for t in reached:
        for e in edges:
            if e.parent == t:
                order.append(e)
                reached.append(e.child)
    if len(reached) != len(tables):
        raise Refused("datasource-unmapped", f"non_star: {sorted(set(tables) - set(reached))} can't be reached")
    deep = any(e.parent != roots[0] for e in order)
    return JoinPlan("single" if not order else "snowflake" if deep else "star", roots[0], tuple(order))


def needed(frames: dict[str, DataFrame], plan: JoinPlan, wanted: Sequence[str]) -> JoinPlan:
    """The plan without dimensions that give none of the wanted columns and lead to none that does: a left join
    to a unique key changes nothing else, but Spark can't know that the key is unique."""
    edges = list(plan.edges)
    for e in reversed(plan.edges):
        if not set(frames[e.child].columns) & set(wanted) and not any(x.parent == e.child for x in edges):
            edges.remove(e)
    return JoinPlan(plan.shape, plan.root, tuple(edges))


def flatten(frames: dict[str, DataFrame], plan: JoinPlan, columns: Sequence[str] | None = None) -> DataFrame:
    """One left join per dimension, so no row of the fact is lost or, keys being unique, doubled. A column
    whose name is taken becomes NAME_TABLE; if that is taken too it is left out. ``columns``: the dimensions'
    columns that are wanted, if not all; keys of further joins are kept."""
    kept = None if columns is None else {*columns, *(e.key for e in plan.edges)}
    out = frames[plan.root]
    names = {(plan.root, c): c for c in out.columns}
    for e in plan.edges:
        dim, renamed = frames[e.child], {}
        taken = set(names.values())
        for c in dim.columns if kept is None else [c for c in dim.columns if c in kept]:
            new = c if c not in taken else f"{c}_{to_phys(e.child)}"
            if new not in taken and new not in renamed.values():
                renamed[c] = new
        if (e.parent, e.key) not in names:
            raise Refused("datasource-unmapped", f"{e.parent}.{e.key} is not there to join on")
        key = F.col(f"`{e.child_key}`").alias("_child_key")
        out = out.join(dim.select(key, *(F.col(f"`{c}`").alias(n) for c, n in renamed.items())), F.col(f"`{names[e.parent, e.key]}`") == F.col("_child_key"), "left").drop("_child_key")
        names |= {(e.child, c): n for c, n in renamed.items()}
    return out


def fan_out(frames: dict[str, DataFrame], plan: JoinPlan) -> dict[str, int]:
    """For each dimension the number of keys that occur more than once (0: the join doubles nothing)."""
    return {r["child"]: r["doubled"] for r in relations(frames, plan).collect()}


def relations(frames: dict[str, DataFrame], plan: JoinPlan) -> DataFrame:
    """A row for each relationship, in one pass over all of its tables and one exchange: ``doubled``, the dimension's keys that occur more than once, and ``orphans``, rows
    whose key no dimension's row has (null keys aside)."""
    whole = all(isinstance(frames[t].schema[c].dataType, IntegralType) for e in plan.edges for t, c in ((e.parent, e.key), (e.child, e.child_key)))
    sides = []
    for i, e in enumerate(plan.edges):
        for t, c, rows in ((e.parent, e.key, 1), (e.child, e.child_key, 0)):
            key = F.col(f"`{c}`").cast("long" if whole else "string").alias("key")
            sides.append(frames[t].select(F.lit(i).alias("edge"), key, F.lit(rows).cast("long").alias("rows"), F.lit(1 - rows).cast("long").alias("held")).where("key IS NOT NULL"))
    names = F.array(*(F.struct(F.lit(e.parent).alias("parent"), F.lit(e.child).alias("child")) for e in plan.edges))
    keys = reduce(DataFrame.unionAll, sides).groupBy("edge", "key").agg(F.sum("rows").alias("rows"), F.sum("held").alias("held"))
    found = keys.groupBy("edge").agg(F.count_if(F.col("held") > 1).alias("doubled"), F.coalesce(F.sum(F.when(F.col("held") == 0, F.col("rows"))), F.lit(0)).alias("orphans"))
    return found.select(F.get(names, F.col("edge"))["parent"].alias("parent"), F.get(names, F.col("edge"))["child"].alias("child"), "doubled", "orphans")


def verify(frames: dict[str, DataFrame], wanted: dict[str, Sequence[str]]) -> list[str]:
    """What is missing of tables and columns; a model is used only if nothing is."""
    return [t for t in wanted if t not in frames] + [f"{t}.{c}" for t, columns in wanted.items() if t in frames for c in columns if c not in frames[t].columns]


def blend(primary: DataFrame, secondary: DataFrame, links: Sequence[str], measures: dict[str, Column], secondary_measures: dict[str, Column]) -> DataFrame:
    """Both sides aggregated to the link fields, then joined: never row with row."""
    left = primary.groupBy(*links).agg(*(m.alias(n) for n, m in measures.items()))
    right = secondary.groupBy(*links).agg(*(m.alias(n) for n, m in secondary_measures.items()))
    renamed = right.select(*(F.col(c).alias(f"_link_{c}") for c in links), *secondary_measures)
    same = [F.col(c).eqNullSafe(F.col(f"_link_{c}")) for c in links]
    return left.join(renamed, same, "left").select(*links, *measures, *secondary_measures)
