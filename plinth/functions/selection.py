"""Exact percentiles of groups of any size and any distribution, by radix selection.

Numbers become 64-bit integers of the same order. A pass fixes 16 bits of the sought values: every task counts the
digits of the rows that share the bits found so far, for all ranks of all groups at once, and these counters are
summed up. So a pass moves counters, never rows: a group that holds a third of the table costs no more than others. As soon as no rank has
more than DIRECT rows left beside it, the rest is counted value by value; values as far apart as 1e-300 and 1e308 take four passes
at most. The values are written once, without their table's other columns, so joins before are done once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.sources.shared import written

BITS, WHOLE = 16, 64
#: Rows beside a rank that are counted value by value.
DIRECT = 1 << 20
#: Rows that are broadcast to the tasks of a pass, of some 50 bytes each; beyond that they are joined by a shuffle.
FEW = 1 << 17


def imaged(rows: DataFrame, value: str = "_v") -> DataFrame:
    """``rows`` with ``_u`` for ``value``: the bits of the number as a long whose unsigned order is that of the numbers; -0.0 is 0.0,
    NaN the greatest, null stays null. Step by step, so that each expression is made once."""
    others = [c for c in rows.columns if c != value]
    rows = rows.select(*others, F.col(value).cast("double").alias("_v"))
    sized = rows.select("*", F.abs("_v").alias("_x"), F.when(F.abs("_v") < float("inf"), F.floor(F.log2(F.abs("_v")))).cast("int").alias("_e"))
    # the exponent from the logarithm, put right where that was rounded to a neighbouring power
    exact = sized.withColumn("_e", F.expr("CASE WHEN pow(2D, _e) > _x THEN _e - 1 WHEN _e < 1023 AND pow(2D, _e + 1) <= _x THEN _e + 1 ELSE _e END"))
    size = F.expr(
        "CASE WHEN isnan(_v) THEN 9218868437227405313L WHEN _x = double('infinity') THEN 9218868437227405312L WHEN _x < 2.2250738585072014E-308D THEN CAST(_x * pow(2D, 537) * pow(2D, 537) AS BIGINT) "
        "ELSE (_e + 1023L) * 4503599627370496L + CAST((_x / pow(2D, _e) - 1) * 4503599627370496D AS BIGINT) END"
    )
    return exact.select(*others, "_v", size.alias("_u")).select(*others, F.expr("CASE WHEN _v < 0 THEN -_u ELSE _u END ^ (-9223372036854775807L - 1)").alias("_u"))


def number(bits: Column) -> Column:
    """The double of an image."""
    signed = bits.bitwiseXOR(F.lit(-(2**63)))
    size = F.abs(signed)
    e, m = F.shiftright(size, 52).cast("int"), size.bitwiseAND(F.lit(2**52 - 1)).cast("double")
    two = lambda n: F.pow(F.lit(2.0), n)
    whole = F.when(e == 0, m * two(F.lit(-537)) * two(F.lit(-537))).when((e == 2047) & (m > 0), F.lit(float("nan"))).when(e == 2047, F.lit(float("inf"))).otherwise((m / 2.0**52 + 1) * two(e - 1023))
    return F.when(signed < 0, -whole).otherwise(whole)


def _bits(done: int, more: int) -> Column:
    """``more`` bits of an image after the first ``done``."""
    found = F.shiftrightunsigned("_u", WHOLE - done - more) if done + more < WHOLE else F.col("_u")
    return found if done == 0 and more == WHOLE else found.bitwiseAND(F.lit((1 << more) - 1))


def _fixed(found: DataFrame) -> tuple[DataFrame, int, bool]:
    """What a pass found, a row for each rank; the most rows beside one; whether it is few. If so it is kept by the driver, else it is written."""
    rows = found.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        return found.sparkSession.createDataFrame(rows, found.schema), max((r["_k"] for r in rows), default=0), True
    kept = written(found)
    return kept, kept.agg(F.max("_k")).first()[0], False


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group with a column for each of ``shares``, between the values at two ranks where a share falls between them.
    Null values don't count, and groups of nulls alone have no row; null keys are a group."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_one"))
    made = selected(df, group, value, shares)
    return made.select(*(F.col("_g")[k].alias(k) for k in keys), *shares)


def selected(df: DataFrame, group: Column, value: str, shares: dict[str, float], into: Sequence[Column] = (), *, images: bool = False) -> DataFrame:
    """(``_g``, a column for each of ``shares``). ``into``: structs of one type made of ``_g``; each row then counts in all of these groups, but its
    value is written, and its digits are counted, once for all of them. ``images``: the values of ``df`` are
    those of ``imaged``, none of them null, and read from a table as it was written, so they are not written again."""
    wide = (lambda df: df.withColumn("_g", F.explode(F.array(*into)))) if into else (lambda df: df)
    if images:
        rows = df.select(group.alias("_g"), F.col(value).alias("_u"))
    else:
        rows = written(imaged(df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")))
    counts = rows.groupBy("_g", F.lit(0).cast("long").alias("_p"), _bits(0, BITS).alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
    if into:
        counts = wide(counts).groupBy("_g", "_p", "_d").agg(F.sum("_k").alias("_k"))
    ranks = [F.struct(F.lit(f"{name}{side}").alias("want"), f(F.lit(p) * (F.col("_n") - 1)).cast("long").alias("rank")) for name, p in shares.items() for side, f in ((0, F.floor), (1, F.ceil))]
    sized = counts.withColumn("_n", F.sum("_k").over(Window.partitionBy("_g")))
    pairs = sized.select("*", F.explode(F.array(*ranks)).alias("x")).select("_g", "_p", "_d", "_k", "_n", "x.*")
    done, more = 0, BITS
    while True:
        upto = F.sum("_k").over(Window.partitionBy("_g", "want").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        found = pairs.withColumn("_upto", upto).where("_upto > rank AND _upto - _k <= rank")
        bits = F.shiftleft("_p", more).bitwiseOR(F.col("_d")) if done else F.col("_d")
        want, most, few = _fixed(found.select("_g", bits.alias("_p"), "want", (F.col("rank") - F.col("_upto") + F.col("_k")).alias("rank"), "_n", "_k"))
        done += more
        if done == WHOLE:
            break
        more = WHOLE - done if most <= DIRECT else BITS
        small = F.broadcast if few else lambda df: df
        near = rows.withColumn("_p", _bits(0, done))
        if into:  # first the rows near any rank, then each of them in its groups
            near = wide(near.join(small(want.select("_p").distinct()), "_p", "left_semi"))
        near = near.join(small(want.select("_g", "_p").distinct()), ["_g", "_p"])
        counts = near.groupBy("_g", "_p", _bits(done, more).alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
        pairs = counts.join(small(want.drop("_k")), ["_g", "_p"])
    at = lambda n: F.max(F.when(F.col("want") == n, number(F.col("_p")))).alias(n)
    made = want.groupBy("_g", "_n").agg(*(at(f"{name}{side}") for name in shares for side in (0, 1)))

    def between(name: str, p: float) -> Column:
        low, high, place = F.col(f"{name}0"), F.col(f"{name}1"), F.lit(p) * (F.col("_n") - 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return made.select("_g", *(between(name, p).alias(name) for name, p in shares.items()))
