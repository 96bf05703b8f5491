"""A Merkle manifest of a dataset, and each row's proof by coordinate lookups.

Rows are leaves: sha256 over their fields. Inside its group (a source) a leaf has a place, in the order of a key; every
ARITY consecutive nodes of a level make one of the next, until one is left, the group's root. The groups' roots, in
the order of the groups, make the root of all in the same way.

A node is told by coordinates: group, level and place. From a leaf's place and its group's size follow the coordinates
of all siblings on its way up. Leaves explode them, join the stored table of nodes, and put what they find in order, which
gives the steps that fold a leaf into the root. DEEP levels go together: a chunk of CHUNK nodes is hashed upwards inside one
row, and the steps above a chunk are looked up once for the chunk, not for each of its leaves. So a node is asked for
by fewer than CHUNK others however many rows a group has, and nobody asks for the upper nodes of a large group a million
times. Places come from one sort in ranges: only the numbers of rows of each range and group meet in a window.

Fields are written as ``-`` for null, else as their number of UTF-8 bytes, ``:`` and the value, so a null and an empty
text differ. A null group is a group like others and comes first; a null key comes first in its group. Rows that repeat
a key are leaves of their own, in the order of their hashes. Texts of any length are hashed where they lie. An empty
table has no leaves and gives no rows. Extra columns aren't part of a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import few, stored

#: Fixed value: nodes that make one of the next level.
ARITY = 3
DEEP = 6
CHUNK = ARITY**DEEP
POWERS = f"array({', '.join(f'{ARITY**k}L' for k in range(DEEP + 1))})"
#: Levels that a tree of n nodes has above the one they are in, DEEP at most.
LEVELS = f"({' + '.join(f'CAST(n > {ARITY**k} AS INT)' for k in range(DEEP))})"
PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def placed(rows: DataFrame, group: str, order: Sequence[str], facts: DataFrame | None = None) -> DataFrame:
    """Adds ``at``, the place of a row in its group from 0, ``n``, the number of the group's rows, and what ``facts`` has of each
    group. ``rows`` are stored; what comes out is stored as well, so that places stay as they are."""
    ranges = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranges = stored(ranges.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    counts = ranges.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    line = Window.partitionBy(group).orderBy("_range")
    earlier = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_range", group, (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    if facts is not None:
        shifts = shifts.join(facts, group)
    more = [c for c in (facts.columns if facts is not None else []) if c != group]
    return stored(ranges.join(few(stored(shifts)), ["_range", group]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("at"), "n", *more))


def climbed(units: DataFrame, facts: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``units``: (g, at, n, hash), stored. All nodes of the DEEP levels from theirs on that have a sibling or a parent,
    as (g, level, place, hash as bytes), and the units of the level above, one for each chunk."""
    rows = F.array_sort(F.collect_list(F.struct("at", "hash")))
    made = units.withColumn("up", F.expr(f"at div {CHUNK}")).groupBy("g", "n", "up", *facts).agg(rows.alias("rows"))
    made = made.select("g", "n", "up", *facts, F.transform("rows", lambda r: r["hash"]).alias("l0"), F.expr(LEVELS).alias("levels"))
    for k in range(1, DEEP + 1):
        parents = F.expr(f"transform(sequence(0, CAST(ceil(size(l{k - 1}) / {ARITY}) AS INT) - 1), i -> sha2(array_join(slice(l{k - 1}, i * {ARITY} + 1, {ARITY}), ''), 256))")
        made = made.withColumn(f"l{k}", F.when(F.col("levels") >= k, parents).otherwise(F.col(f"l{k - 1}")))
    made = stored(made.drop("l0"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.when(F.col("levels") > k, F.col(f"l{k}")).alias("hashes")) for k in range(1, DEEP))))
    upper = made.select("g", "up", each.alias("x")).select("g", "up", "x.level", F.posexplode("x.hashes").alias("i", "hash"))
    upper = upper.select("g", "level", F.expr(f"up * element_at({POWERS}, {DEEP} - level + 1) + i").alias("place"), F.unhex("hash").alias("hash"))
    nodes = units.select("g", F.lit(0).alias("level"), F.col("at").alias("place"), F.unhex("hash").alias("hash")).unionAll(upper)
    above = made.select("g", F.col("up").alias("at"), F.expr(f"CAST(ceil(n / {CHUNK}) AS BIGINT)").alias("n"), F.col(f"l{DEEP}")[0].alias("hash"), *facts)
    return nodes, above


def steps(units: DataFrame, nodes: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(g, at, ``own``, and what is ``kept`` of the units): the steps of each unit on the levels of its chunk. It explodes the
    coordinates of its siblings there and joins the nodes; these and the unit's own row meet in one exchange and are put in order."""
    levels = ", ".join(map(str, range(DEEP)))
    wanted = F.expr(
        f"filter(flatten(transform(array({levels}), k -> transform(array({', '.join(map(str, range(ARITY)))}), j -> named_struct('level', k, 'place', (at div element_at({POWERS}, k + 1)) div {ARITY} * {ARITY} + j)))), "
        f"x -> x.level < {LEVELS} AND x.place < ceil(n / element_at({POWERS}, x.level + 1)) AND x.place != at div element_at({POWERS}, x.level + 1))"
    )
    asked = units.select("g", "at", F.explode(wanted).alias("x")).select("g", "at", "x.level", "x.place")
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    found = asked.join(nodes, ["g", "level", "place"])
    rows = found.select("g", "at", F.struct("level", "place", "hash").alias("s"), *(none(c, units) for c in ("n", *kept)))
    own = F.lit(None).cast(rows.schema["s"].dataType).alias("s")
    met = rows.unionAll(units.select("g", "at", own, "n", *kept)).groupBy("g", "at").agg(F.array_sort(F.collect_list("s")).alias("siblings"), *(F.max(c).alias(c) for c in ("n", *kept)))
    side = lambda sign: f"array_join(transform(filter(siblings, s -> s.level = k AND s.place {sign} at div element_at({POWERS}, k + 1)), s -> lower(hex(s.hash))), '')"
    return met.select("g", "at", F.expr(f"transform(filter(array({levels}), k -> k < {LEVELS}), k -> named_struct('before', {side('<')}, 'after', {side('>')}))").alias("own"), *kept)


@dataclass
class Tree:
    """Of one or many groups: ``tiers``, DEEP levels each, (units, nodes); ``roots``: (g, hash, and facts of the group)."""

    tiers: list[tuple[DataFrame, DataFrame]]
    roots: DataFrame

    @classmethod
    def of(cls, units: DataFrame, facts: Sequence[str] = ()) -> Tree:
        """``units``: (g, at, n, hash, and ``facts``, the same in all of a group), stored."""
        tiers, most = [], units.agg(F.max("n")).first()[0] or 0
        while most > 1:
            nodes, above = climbed(units, facts)
            tiers.append((units, nodes))
            units, most = above, -(-most // CHUNK)
        return cls(tiers, units.select("g", "hash", *facts))

    def paths(self, leaves: DataFrame, above: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
        """``leaves``: the lowest units with what is ``kept``, beside which comes ``path`` and what else ``above``, (g, path, ...) of
        the roots, has."""
        found = above.withColumn("at", F.lit(0).cast("long"))
        more = [c for c in above.columns if c not in ("g", "path")]
        if not self.tiers:
            return leaves.select("g", "at", *kept).join(found, ["g", "at"])
        for i in range(len(self.tiers) - 1, -1, -1):
            units, nodes = self.tiers[i]
            mine = () if i else kept
            own = steps(units if i else leaves, nodes, mine).withColumn("_up", F.expr(f"at div {CHUNK}"))
            upper = few(stored(found)).select("g", F.col("at").alias("_up"), F.col("path").alias("_path"), *more)
            found = own.join(upper, ["g", "_up"]).select("g", "at", *mine, F.concat("own", "_path").alias("path"), *more)
        return found


@dataclass
class Manifest:
    """``leaves``: (g, at, n, hash and what else the caller keeps); ``within``: the groups' trees; ``groups``: (group, g, number of
    groups); ``tops``: the groups' roots as units of ``over``, one tree; ``root``: (hash), a row or none."""

    leaves: DataFrame
    within: Tree
    groups: DataFrame
    tops: DataFrame
    over: Tree

    @property
    def root(self) -> DataFrame:
        return self.over.roots.select("hash")

    def proofs(self, kept: Sequence[str] = ()) -> DataFrame:
        """The leaves (``hash``, and what is ``kept``) with ``subroot``, ``root`` and ``path``, an array of steps from the leaf up to
        the root, each with the siblings ``before`` and ``after``, as hex digits one after the other."""
        top = self.over.roots.select("g", F.array().cast(PATH).alias("path"))
        of = self.over.paths(self.tops, top, ["hash"]).select(F.col("at").alias("g"), "path", F.col("hash").alias("subroot"))
        return self.within.paths(self.leaves, of, ["hash", *kept]).withColumn("root", self.root.select("hash").scalar())


def manifest(rows: DataFrame, group: str, order: str, *, kept: Sequence[str] = ()) -> Manifest:
    """``rows``: columns ``hash``, ``group``, ``order`` and those that are ``kept``. Nulls of the group come first."""
    rows = stored(rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("_g"), F.col(order).alias("_o"), "hash", *kept))
    groups = stored(rows.select("_g").distinct().withColumn("_all", F.lit(0)))
    groups = placed(groups, "_all", ["_g"]).select("_g", F.col("at").alias("g"), F.col("n").alias("groups"))
    leaves = placed(rows, "_g", ["_o", "hash"], groups)
    within = Tree.of(leaves.select("g", "at", "n", "hash", "groups"), ["groups"])
    tops = stored(within.roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.col("groups").alias("n"), "hash"))
    return Manifest(leaves, within, groups, tops, Tree.of(tops))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audited(docs: DataFrame, tampered: Column, *, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """A manifest of ``docs`` and the check of a copy whose ``text`` is ``tampered``. Per row: ``order``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` of the original; ``folded_root``, made from the copy's leaf and the original siblings; ``verified``."""
    original = [F.col(c) for c in columns]
    copy = [tampered if c == text else F.col(c) for c in columns]
    same = tampered.eqNullSafe(F.col(text))
    rows = docs.select(F.col(group).alias("_group"), F.col(order).alias("_order"), leaf(original).alias("hash"), F.when(~same, leaf(copy)).alias("other"))
    made = manifest(rows.withColumn("id", F.col("_order")), "_group", "_order", kept=("id", "other"))
    found = made.proofs(("id", "other")).withColumn("folded_root", folded(F.coalesce("other", "hash"), F.col("path")))
    return found.select(F.col("id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
