"""A uniform shuffle into shards of exact sizes, with a hypergeometric communication matrix.

Law ``rows``: the shards' numbers of rows differ by one at most. Documents lie in cells (CELL rows on average
at most, by a hash of their id); how many of each cell go to each shard is drawn from the multivariate hypergeometric law
that a uniform permutation of all rows induces. Each cell is permuted for itself and cut by these numbers,
the rows are exchanged, and each shard is permuted again: in blocks of like size, then inside each block.

Everything on the rows is DataFrame functions. The driver sees one number of rows per cell (of CELL rows, about
a million, beyond 256 cells) and draws the matrix from them, level by level as arrays: 100,000 cells for 1e11 rows.

A null text has size 1 and the checksum of no bytes. Rows that repeat an id or a text are rows of their own
(equal texts are scattered like others; ties in the hashes are broken by id and checksum). An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import stored

CELL, SMALL = 1 << 20, 1_000


def pieces(n: int, shards: int = 1) -> int:
    """Cells of all rows or blocks of a shard: of SMALL rows, but 256 in all; beyond that of CELL rows."""
    n = -(-n // shards)
    return max(1, min(-(-n // SMALL), -(-256 // shards)), -(-n // CELL))


def below(seed: int, bound: Column, *parts: Column) -> Column:
    """0 to bound - 1, evenly, by a hash of the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), bound.cast("long"))


def matrix(cells: list[int], shards: int, seed: int) -> np.ndarray:
    """(cells, shards): how many rows of each cell go to each shard. The shards' totals differ by one at
    most; given them, every assignment of rows is equally likely. Cells are halved again and again: what each
    shard gives to the left half is drawn without replacement, for all halves of a level at once."""
    rng = np.random.default_rng(seed)
    total = sum(cells)
    out = np.array([[total // shards + (s < total % shards) for s in range(shards)]], np.int64)
    width = 1 << max(0, len(cells) - 1).bit_length()
    sizes = np.zeros(width, np.int64)
    sizes[: len(cells)] = cells
    while len(out) < width:
        rest = sizes.reshape(2 * len(out), -1).sum(axis=1)[::2].copy()  # rows of the left halves
        free, left = out.sum(axis=1), np.zeros_like(out)
        for s in range(shards):
            free -= out[:, s]
            left[:, s] = hypergeometric(rng, out[:, s], free, rest)
            rest -= left[:, s]
        out = np.stack([left, out - left], 1).reshape(-1, shards)
    return out[: len(cells)]


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """numpy draws where its limit of 1e9 allows, and ``large`` beyond."""
    small = good + bad < 1_000_000_000
    out = np.zeros(len(good), np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    for i in np.flatnonzero(~small).tolist():
        out[i] = large(rng, int(good[i]), int(bad[i]), int(draws[i]))
    return out


def large(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The same at any size, by the same law. Each ball is taken or left by itself (two binomial numbers), so
    that all sets of as many balls are equally likely; what is too many or too few by then, about the root of
    ``draws``, is put back or taken on by the same law from a smaller urn or in fewer draws."""
    if not draws or not good:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    if 2 * draws > good + bad:
        return good - large(rng, good, bad, good + bad - draws)
    if draws <= 64:
        taken = 0
        for k in range(draws):
            taken += int(rng.integers(good + bad - k)) < good - taken
        return taken
    x, y = (int(rng.binomial(n, draws / (good + bad))) for n in (good, bad))
    if x + y > draws:
        return x - large(rng, x, y, x + y - draws)
    return x + large(rng, good - x, bad - y, draws - x - y)


def shuffle(docs: DataFrame, *, shards: int = 8, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``size`` long, ``text_crc32`` long, ``law`` string, ``shard`` int, ``slot`` long, ``grown_shard``
    int, null under this law) for each row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(docs.select(id_col, (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")))
    n = rows.count()
    cells = pieces(n)
    rows = rows.withColumn("_cell", below(seed, F.lit(cells), F.col(id_col), F.col("size"), F.col("text_crc32")).cast("int"))
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = matrix([counts.get(c, 0) for c in range(cells)], shards, seed).cumsum(axis=1)
    bounds = spark.createDataFrame([(c, drawn[c].tolist()) for c in range(cells)], "_cell int, _bounds array<long>")
    within = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("text_crc32")), id_col, "text_crc32")
    placed = rows.withColumn("_rank", F.row_number().over(within)).join(bounds, "_cell")
    shard = sum((F.col("_rank") > F.col("_bounds")[s]).cast("int") for s in range(shards - 1)) if shards > 1 else F.lit(0)
    # inside its shard: a block by a hash, and a place by another
    blocks = pieces(n, shards)
    again = [F.col(id_col), F.col("text_crc32"), F.col("_cell"), F.col("_rank")]
    placed = stored(placed.select(id_col, "size", "text_crc32", shard.cast("int").alias("shard"), below(seed + 2, F.lit(blocks), *again).alias("_block"), F.xxhash64(F.lit(seed + 3), *again).alias("_order")))
    sizes = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_order", id_col, "text_crc32")
    found = placed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["shard", "_block"])
    return found.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
