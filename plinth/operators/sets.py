"""Sets of members and what they have in common: each member's membership in all sets is one bit mask, from one aggregation.

Combined sets are bit tests on the masks, so union, intersection and difference of any number of sets read the facts once. A null member is a member, equal
to null, as in INTERSECT and EXCEPT; a set without members is empty."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.plans.findings import Refused


@dataclass(frozen=True)
class Sets:
    """``masks``: (member, ``_mask``), a row for each member of the table."""

    masks: DataFrame
    member: str
    names: tuple[str, ...]

    def bits(self, names: Sequence[str]) -> int:
        if unknown := set(names) - set(self.names):
            raise Refused("filter-not-pushed", f"no set {sorted(unknown)}")
        return sum(1 << self.names.index(n) for n in set(names))

    def any_of(self, *names: str) -> Column:
        return F.col("_mask").bitwiseAND(F.lit(self.bits(names))) != 0

    def all_of(self, *names: str) -> Column:
        return F.col("_mask").bitwiseAND(F.lit(self.bits(names))) == self.bits(names)

    def members(self, test: Column) -> DataFrame:
        return self.masks.where(test).select(self.member)

    def union(self, *names: str) -> DataFrame:
        return self.members(self.any_of(*names))

    def intersection(self, *names: str) -> DataFrame:
        """The shared members."""
        return self.members(self.all_of(*names))

    def difference(self, left: str, *right: str) -> DataFrame:
        """The members of ``left`` that are in none of the others."""
        return self.members(self.all_of(left) & ~self.any_of(*right) if right else self.all_of(left))

    def marked(self, df: DataFrame, test: Column, name: str = "SET") -> DataFrame:
        """Beside each row "In" or "Out" by its member."""
        key = lambda t: t.withColumn("_key", F.struct(self.member))  # noqa: E731  nulls in a struct are equal
        found = key(self.masks).select("_key", F.when(test, "In").otherwise("Out").alias(name))
        return key(df).join(found, "_key", "left").drop("_key").fillna("Out", [name])


def sets(df: DataFrame, member: str, conditions: dict[str, Column], listed: dict[str, DataFrame] | None = None) -> Sets:
    """``conditions``: aggregates over a member's rows that say whether it is in; ``listed``: tables of members (a top-N set, say)."""
    names = (*conditions, *(listed or {}))
    if len(names) > 63:
        raise Refused("filter-not-pushed", "more than 63 sets")
    bit = lambda n: F.lit(1 << names.index(n)).cast("long")
    mask = reduce(Column.bitwiseOR, [F.when(c, bit(n)).otherwise(F.lit(0).cast("long")) for n, c in conditions.items()], F.lit(0).cast("long"))
    masks = df.groupBy(member).agg(mask.alias("_mask"))
    for n, table in (listed or {}).items():
        masks = masks.unionAll(table.select(F.col(member), bit(n).alias("_mask")))
    if listed:
        masks = masks.groupBy(member).agg(F.bit_or("_mask").alias("_mask"))
    return Sets(masks, member, names)
