"""Which words of documents repeat a passage of a benchmark: a prefix-filtered join on shingles.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. Containment asks for the
whole window, so of its shingles (SHINGLE words, or all of a shorter window) the prefix that a document must
share is one shingle: the rarest, by its count in all documents. Documents are joined to windows on that
shingle alone. A match fixes where the window would have to start (positional bound: not before the text's
first word; length bound: not past its last), and the words there are then compared one by one.

A null text, of a document or an item, has no words. Repeated rows are reported one by one; repeated items
count each under its own id. Empty tables give no rows, or rows without hits. Extra columns are ignored.
Very long texts are read whole. Counting and joining go through the items in blocks of ITEMS_BLOCK windows,
so what a task holds of them is bounded; benchmarks of usual size are one block. Of a shingle that is common (an
item of one word, say) each occurrence carries no more words around it than its windows have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import arrow_map, stored, text_chunks, utf8
from plinth.llm.words import PLAIN, words

SHINGLE = 3
#: Windows whose shingles a task looks up at once: 8 shingles of 8 bytes each at most, so 8 MB are broadcast.
ITEMS_BLOCK = 1 << 17
#: Bytes of a block's windows up to which they are broadcast; beyond it they are joined by a shuffle in which each
#: shingle is spread over SALTS tasks.
BROADCAST, SALTS = 1 << 25, 64


def item_windows(items: DataFrame, window: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(``item``, ``passage`` string: the window's words with one blank between, ``size`` int, ``tokens``
    array of the hashes of its shingles) for each distinct window of each item."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("")
            for a, b in text_chunks(column):
                found = words(*utf8(column[a:b]), PLAIN)
                rows: list[tuple] = []
                for i in range(b - a):
                    lo, hi = int(found.texts[i]), int(found.texts[i + 1])
                    size = min(window, hi - lo)
                    if not size:
                        continue
                    every = found.shingles(min(SHINGLE, size)).view(np.int64)
                    for at in range(lo, hi - size + 1):
                        rows.append((i, found.text(at, at + size), size, every[at : at + size - min(SHINGLE, size) + 1].tolist()))
                key = batch.column(0)[a:b].take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([key, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["item", "passage", "size", "tokens"])

    return arrow_map(items.select(id_col, text_col), run, f"item {kind}, passage string, size int, tokens array<bigint>").dropDuplicates(["item", "passage"])


class Lookup:
    """Membership of hashes in a set: a bit map first, then a search in the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.view(np.uint64))
        self.map = np.zeros(1 << 22, bool)
        self.map[self._low(self.sorted)] = True

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << 22) - 1)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those that are members, and which members they are."""
        at = np.flatnonzero(self.map[self._low(hashes)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        ok = self.sorted[which] == hashes[at]
        return at[ok], which[ok]


def column(df: DataFrame, name: str) -> np.ndarray:
    """A column of a bounded table, on the driver."""
    return df.select(F.col(name).cast("long")).toArrow().column(0).to_numpy()


def occurrences(docs: DataFrame, tokens: np.ndarray, sizes: list[int], text_col: str) -> DataFrame:
    """(``token``, ``n``): how often each of the hashes occurs in all documents; summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        total = np.zeros(len(lookup.sorted), np.int64)
        for batch in batches:
            column = batch.column(0).fill_null("")
            for a, b in text_chunks(column):
                found = words(*utf8(column[a:b]), PLAIN)
                for size in sizes:
                    total += np.bincount(lookup(found.shingles(size))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lookup.sorted[seen].view(np.int64)), pa.array(total[seen])], ["token", "n"])

    return arrow_map(docs.select(text_col), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, tokens: np.ndarray, reach: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """Per row: a number ``row``, the id, ``n_words`` and ``found``: for each occurrence of one of the hashes
    its place and the words around it, as far as a window with it can ``reach``."""
    order = np.argsort(tokens.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((tokens[order], reach[order]))
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, far = Lookup(shared.value[0]), shared.value[1]
        for batch in batches:
            column = batch.column(2).fill_null("")
            for a, b in text_chunks(column):
                found = words(*utf8(column[a:b]), PLAIN)
                rows: list[list] = [[] for _ in range(b - a)]
                for size in sizes:
                    at, which = lookup(found.shingles(size))
                    of = np.searchsorted(found.texts, at, "right") - 1
                    for x, k, i, window in zip(at.tolist(), lookup.sorted[which].view(np.int64).tolist(), of.tolist(), far[which].tolist(), strict=True):
                        lo, hi = int(found.texts[i]), int(found.texts[i + 1])
                        if x + size <= hi:
                            first = max(lo, x - window + size)
                            rows[i].append({"token": k, "at": x - lo, "lead": x - first, "around": found.text(first, min(hi, x + window))})
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(found.texts)), pa.array(rows, shape)], ["row", id_col, "n_words", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
    return arrow_map(rows, run, f"row long, `{id_col}` {kind}, n_words long, found array<struct<token:bigint,at:bigint,lead:int,around:string>>")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``
    long, ``items_sha256`` string (of the items' ids as strings, sorted, with commas), ``contaminated``."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, window, id_col=item_col).withColumn("block", F.pmod(F.xxhash64("item", "passage"), F.lit(1 << 20))))
    n = windows.count()
    blocks = max(1, -(-n // ITEMS_BLOCK))
    hits, base = [], None
    for k in range(blocks):
        part = windows.where(F.col("block") % blocks == k)
        exploded = part.select("item", "passage", "size", F.posexplode("tokens").alias("offset", "token"))
        tokens = column(exploded.select("token").distinct(), "token")
        sizes = sorted(min(SHINGLE, r[0]) for r in part.select("size").distinct().collect())
        sizes = sorted(set(sizes))
        counts = stored(occurrences(docs, tokens, sizes, text_col)) if len(tokens) else spark.createDataFrame([], "token long, n long")
        # the rarest shingle of each window; one that no document has rules the window out
        order = Window.partitionBy("item", "passage").orderBy("n", "token", "offset")
        prefix = exploded.join(F.broadcast(counts), "token", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("place", F.row_number().over(order)).where("place = 1 and n > 0").drop("place", "n")
        prefix = stored(prefix)
        keys = prefix.groupBy("token").agg(F.max("size").cast("long").alias("reach")).toArrow()
        found = stored(places(docs, keys["token"].to_numpy(), keys["reach"].to_numpy(), sizes, id_col, text_col))
        base = found.select("row", id_col, "n_words") if base is None else base
        at = found.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
        if (prefix.agg(F.sum(F.octet_length("passage") + 64)).first()[0] or 0) <= BROADCAST:
            joined = at.join(F.broadcast(prefix), "token")
        else:
            salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = at.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
        start = F.col("at") - F.col("offset")
        inside = (start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("offset"))
        same = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size")), " ") == F.col("passage")
        hits.append(joined.where(inside).where(same).select("row", "item", start.alias("start"), (start + F.col("size")).alias("end")))
    hit = stored(reduce(DataFrame.unionAll, hits))
    spans = hit.groupBy("row", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0)))).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    which = hit.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = base.join(covered, "row", "left").join(which, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
