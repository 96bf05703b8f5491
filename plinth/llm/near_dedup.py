"""Groups of near-duplicate texts: an LSH forest over MinHash signatures, links confirmed on full sets.

A text's set holds its distinct shingles of ``shingle`` lower-cased words (of the whole sequence, if there
are fewer). Texts with equal sets (by a 128-bit digest of the shingles themselves) are one class; the rest
concerns one text of each class.

1. A signature of HASHES 16-bit minima. Each of TREES trees reads them in an order of its own: the first
   DEPTH of that order are the text's label in the tree.
2. Labels that share their first LEAST values with another are sorted, tree by tree, in ranges that Spark
   chooses by size. Neighbours in that order have the longest common prefixes; where a region is crowded the
   NEAR nearest rows agree to a greater depth by themselves. A pair is a candidate if its signatures agree in
   so many places as a pair at the threshold falls short of in 1 of 10,000 cases.
3. Candidates are confirmed by the exact sizes of intersection and union of the full sets, shingles of equal
   hashes being compared word by word: first each text's
   FIRST likeliest, then all that still lead from one group to another; where those fail, the text is held
   against the centres of that group. What later links join are groups, not texts.
4. A row that shares its first LEAST values with rows more than NEAR places away, or across the bound of a
   range, is crowded. All pairs of crowded texts that are in different groups by then are decided exactly: a
   pair at the threshold shares one of each text's first shingles, if those that one group alone holds come
   first and the others by their number of holders; what length and place of such a shingle don't rule out is
   confirmed on full sets.
5. Groups are the connected components of the confirmed links.

Pairs are never made of all members of a group: each text has NEAR neighbours in each tree, and step 4 makes
pairs of different groups alone. A link is lost only where its texts are not crowded and their signatures fall
short (see 2), or share no head in any tree.

A null or empty text, or one of white space alone, has an empty set and is linked with nothing. Rows that
repeat an id are one document each, with its own text and that id. Ids of any type that has an order; not null. Very long texts have large sets but
signatures of the same size. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import arrow_map, few, stored, text_chunks, utf8
from plinth.llm.words import VISIBLE, Words, mixed, words

HASHES, TREES, DEPTH, LEAST = 256, 24, 32, 3
NEAR, FIRST = 6, 2
#: Holders of a shingle that are compared in one piece; longer lists are cut into pairs of such blocks.
BLOCK = 512
_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDERS = np.array([_rng.permutation(HASHES)[:DEPTH] for _ in range(TREES)])


@dataclass
class Set:
    """A text's distinct shingles: their hashes in ascending order, a place of each, the words of a shingle,
    and the bounds of all places."""

    hashes: np.ndarray
    places: np.ndarray
    size: int
    bounds: tuple[int, int]


def sets(found: Words, shingle: int) -> list[Set]:
    every, out = {0: np.zeros(0, np.uint64)}, []
    for a, b in zip(found.texts.tolist(), found.texts[1:].tolist(), strict=False):
        size = min(shingle, b - a)
        if size not in every:
            every[size] = found.shingles(size)
        end = b - size + 1 if size else a
        hashes, places = np.unique(every[size][a:end], return_index=True)
        out.append(Set(hashes, places + a, size, (a, end)))
    return out


#: Shingles whose bytes are laid out at once.
SOME = 8192


def digests(found: Words, members: list[Set]) -> list[bytes]:
    """Of each text's set: of the shingles themselves, in the order of their hashes."""
    out = []
    for m in members:
        digest = hashlib.blake2b(digest_size=16)
        for k in range(0, len(m.places), SOME):
            digest.update(found.passages(m.places[k : k + SOME], m.size)[0])
        out.append(digest.digest())
    return out


def alike(x: Words, i: np.ndarray, y: Words, j: np.ndarray, size: int) -> bool:
    """Whether the shingles at these places are equal, one by one."""
    for k in range(0, len(i), SOME):
        one, two = x.passages(i[k : k + SOME], size), y.passages(j[k : k + SOME], size)
        if not (np.array_equal(one[1], two[1]) and np.array_equal(one[0], two[0])):
            return False
    return True


def linked(x: Words, s: Set, y: Words, t: Set, share: int) -> bool:
    """100 * |intersection| >= share * |union|. Shingles of equal hashes are compared word by word."""
    if s.size != t.size or not s.size or 100 * min(len(s.hashes), len(t.hashes)) < share * max(len(s.hashes), len(t.hashes)):
        return False
    _, i, j = np.intersect1d(s.hashes, t.hashes, assume_unique=True, return_indices=True)
    enough = lambda both, union: 100 * both >= share * union
    if not enough(len(i), len(s.hashes) + len(t.hashes) - len(i)):
        return False
    if alike(x, s.places[i], y, t.places[j], s.size):
        return True
    full = [{f.passages(np.array([k]), m.size)[0].tobytes() for k in range(*m.bounds)} for f, m in ((x, s), (y, t))]  # hashes collide
    return enough(len(full[0] & full[1]), len(full[0] | full[1]))


def signature(members: np.ndarray) -> bytes:
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(members), 4096):
            np.minimum(least, (members[i : i + 4096, None] * FACTORS[None, :]).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def signatures(docs: DataFrame, shingle: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``text_hash`` long, ``n_shingles`` long, ``key`` binary: a digest of the set, ``sig`` binary)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).fill_null("")
            for a, b in text_chunks(column):
                found = words(*utf8(column[a:b]), VISIBLE)
                members = sets(found, shingle)
                known: dict[bytes, bytes] = {}
                keys = digests(found, members)
                for k, m in zip(keys, members, strict=True):
                    if k not in known:
                        known[k] = signature(m.hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(m.hashes) for m in members], pa.int64()), pa.array(keys, pa.binary()), pa.array([known[k] for k in keys], pa.binary())], [id_col, "text_hash", "n_shingles", "key", "sig"])

    return arrow_map(docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col), run, f"`{id_col}` {kind}, text_hash long, n_shingles long, key binary, sig binary")


def neighbours(labels: DataFrame, agree: int) -> DataFrame:
    """``labels``: (tree int, label binary, rep long, sig binary) in ranges, sorted. Pairs (a, b, same) of
    rows at most NEAR apart in a tree whose labels share LEAST values and whose signatures share ``agree``; and
    (a, a, 0) of rows some of whose pairs sharing LEAST values are not looked at: they are further apart, or
    may lie in another range."""

    def made(a: list[np.ndarray], b: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64()), pa.array(np.concatenate(s), pa.int32())], ["a", "b", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, ...] | None = None
        begin: np.ndarray | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            head = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, DEPTH)[:, :LEAST]
            head = np.concatenate([batch.column(0).to_numpy()[:, None], head.astype(np.int32)], 1)
            rep, sig = batch.column(2).to_numpy(), np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(n, HASHES)
            now = (head, rep, sig) if last is None else tuple(np.concatenate(x) for x in zip(last, (head, rep, sig), strict=True))
            old = 0 if last is None else len(last[1])
            begin = head[0] if begin is None else begin
            i = np.arange(max(0, old - NEAR - 1), len(now[1]) - NEAR - 1)
            i = i[(now[0][i] == now[0][i + NEAR + 1]).all(axis=1)]
            crowded = np.unique(np.concatenate([now[1][i], now[1][i + NEAR + 1], rep[(head == begin).all(axis=1)]]))
            a, b, s = [crowded], [crowded], [np.zeros(len(crowded), np.int32)]
            for k in range(1, min(NEAR, len(now[1]) - 1) + 1):
                i = np.arange(max(0, old - k), len(now[1]) - k)  # the later row is new
                i = i[(now[0][i] == now[0][i + k]).all(axis=1)]
                for part in np.array_split(i, max(1, len(i) // 4096)):
                    same = (now[2][part] == now[2][part + k]).sum(axis=1)
                    ok = same >= agree
                    one, two = now[1][part[ok]], now[1][part[ok] + k]
                    a.append(np.minimum(one, two))
                    b.append(np.maximum(one, two))
                    s.append(same[ok])
            last = tuple(x[-2 * (NEAR + 1) :] for x in now)  # of a longer run with one head all rows are crowded
            yield made(a, b, s)
        if last is not None:
            crowded = last[1][(last[0] == last[0][-1]).all(axis=1)]
            yield made([crowded], [crowded], [np.zeros(len(crowded), np.int32)])

    return arrow_map(labels, run, "a long, b long, same int")


def candidates(reps: DataFrame, agree: int) -> DataFrame:
    """``reps``: (rep long, sig binary). Distinct pairs (a, b, same), a < b, and (a, a, 0) of crowded rows."""
    head = lambda order: F.conv(F.hex(F.concat(*(F.substring("sig", int(2 * k + 1), 2) for k in order[:LEAST]))), 16, 10).cast("long")
    heads = F.array(*(F.lit(t << 16 * LEAST) + head(order) for t, order in enumerate(ORDERS)))
    heads = stored(reps.select("rep", F.explode(heads).alias("head")))
    shared = few(stored(heads.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head")))
    rows = stored(heads.join(shared, "head", "left_semi"))
    crowd = rows.groupBy("rep").agg(F.collect_list(F.shiftright("head", 16 * LEAST).cast("int")).alias("trees"))
    label = F.element_at(F.array(*(F.concat(*(F.substring("sig", int(2 * k + 1), 2) for k in order)) for order in ORDERS)), F.col("tree") + 1)
    rows = reps.join(crowd, "rep").select("rep", "sig", F.explode("trees").alias("tree")).withColumn("label", label).select("tree", "label", "rep", "sig")
    rows = rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    return neighbours(rows, agree).groupBy("a", "b").agg(F.max("same").alias("same"))


def confirmed(pairs: DataFrame, texts: DataFrame, share: int, shingle: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` with 100 * |intersection| >= share * |union| of the full sets of
    ``texts`` (rep long, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in text_chunks(batch.column(2)):
                x, y = (words(*utf8(batch.column(k)[a:b]), VISIBLE) for k in (2, 3))
                good += [linked(x, s, y, t, share) for s, t in zip(sets(x, shingle), sets(y, shingle), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    of = lambda c, t: texts.select(F.col("rep").alias(c), F.coalesce("text", F.lit("")).alias(t))
    both = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    return arrow_map(both, compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, ``root``: the smallest node reachable) of all nodes with a link (a, b), a < b. Each round links
    every node's greater neighbours to its smallest one, then its smaller ones, until stars are left: graphs in
    which no node with a smaller neighbour has any other."""
    edges = stored(links.select("a", "b"))
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
        if near.where("low < a AND low < high").isEmpty():
            return near.select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        large = edges.join(near.select("a", F.least("a", "low").alias("m")), "a").select(F.col("m").alias("a"), "b")
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        edges = stored(small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct())


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs whose ends are not yet in one group, with the ends' ``root_a`` and ``root_b``."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b")).where("root_a != root_b")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links: the components of the groups, not of the nodes."""
    between = stored(across(links, roots).select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    if between.isEmpty():
        return roots
    more = components(between).select(F.col("node").alias("group"), F.col("root").alias("top"))
    old = roots.join(more, F.col("root") == F.col("group"), "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(roots, F.col("group") == F.col("node"), "left_anti").select(F.col("group").alias("node"), F.col("top").alias("root"))
    return stored(old.unionAll(new))


def towards_centres(pairs: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """For each pair that failed: one end with the centre of the other's group, as seen from the other end (of
    itself and its neighbours by ``links`` the one with the most links, and that one's own such). Edited
    copies may be near their original alone, and near in many trees to each other. Distinct pairs (a, b)."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = stored(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    near = both.unionAll(degree.select("a", F.col("a").alias("b"))).join(few(degree.select(F.col("a").alias("b"), "n")), "b")  # a centre is the b of many
    centre = stored(near.groupBy("a").agg(F.max(F.struct("n", F.col("b").alias("c"))).alias("m")).select("a", F.col("m.c").alias("c")))
    further = centre.join(few(centre.select(F.col("a").alias("c"), F.col("c").alias("d"))), "c").select("a", F.array_distinct(F.array("c", "d")).alias("to"))
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = ends.join(further.select(F.col("a").alias("b"), "to"), "b").select("a", F.explode("to").alias("c")).where("a != c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    return across(found, roots).select("a", "b")


def crowded_pairs(crowd: DataFrame, texts: DataFrame, share: int, shingle: int) -> DataFrame:
    """``crowd``: (rep, root). Distinct pairs (a, b, same), a < b, of different roots; every pair of them with
    100 * |intersection| >= share * |union| of the sets of ``texts`` (rep, text) is among them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch.column(2)):
                members = [m.hashes for m in sets(words(*utf8(batch.column(2)[a:b]), VISIBLE), shingle)]
                n = np.array(list(map(len, members)), np.int64)
                of = [np.repeat(batch.column(k)[a:b].to_numpy(), n) for k in (0, 1)]
                every = np.concatenate(members).view(np.int64)
                for at in range(0, len(every), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (*of, np.repeat(n, n), every)], ["rep", "root", "n", "g"])

    rows = arrow_map(crowd.join(texts, "rep").select("rep", "root", F.coalesce("text", F.lit("")).alias("text")), spread, "rep long, root long, n long, g long")
    rows = stored(rows)
    # what one group alone holds makes no pair, and comes first in every text
    shared = rows.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("g", "many")
    held = rows.join(few(stored(shared)), "g").groupBy("rep", "root", "n").agg(F.array_sort(F.collect_list(F.struct("many", "g"))).alias("s"))
    held = held.withColumn("need", F.expr(f"({share} * n + 99) div 100")).where("size(s) >= need")
    held = held.select("rep", "root", "n", F.size("s").alias("m"), F.posexplode(F.expr("slice(s, 1, CAST(size(s) - need + 1 AS INT))")).alias("pos", "x"))
    held = stored(held.select("rep", "root", "n", F.expr("m - pos").alias("rest"), "x.g"))
    long = held.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(f"k > {BLOCK}").select("g", F.expr(f"CAST(ceil(k / {BLOCK}) AS INT)").alias("cuts"))
    cut = held.join(few(stored(long)), "g", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", F.expr("CAST(pmod(xxhash64(rep), cuts) AS INT)"))
    one = cut.select("g", F.col("own").alias("i"), F.explode(F.expr("sequence(own, cuts - 1)")).alias("j"), *(F.col(c).alias(f"{c}_a") for c in ("rep", "root", "n", "rest")))
    two = cut.select("g", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("rep", "root", "n", "rest")))
    # of the first shared shingle of a pair: all that is shared is in the rest of both
    fits = f"root_a != root_b AND (one.i < one.j OR rep_a < rep_b) AND 100 * least(n_a, n_b) >= {share} * greatest(n_a, n_b) AND 100 * least(rest_a, rest_b) >= {share} * (n_a + n_b - least(rest_a, rest_b))"
    found = one.alias("one").join(two.alias("two"), F.expr(f"one.g = two.g AND one.i = two.i AND one.j = two.j AND {fits}"))
    return found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), F.lit(0).alias("same")).distinct()


def least_agreement(share: int) -> int:
    """Places of HASHES in which a pair of similarity share / 100 agrees but in 1 of 10,000 cases."""
    p = share / 100
    return int(HASHES * p - 3.7 * (HASHES * p * (1 - p)) ** 0.5)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_shingles`` long, ``component_id``: the smallest id reachable by links, ``kept`` boolean:
    it is the own id) for each row. Links: 100 * |intersection| >= ``share`` * |union|."""
    signed = stored(signatures(docs, shingle, id_col=id_col, text_col=text_col))
    classes = signed.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_hash", "sig")).alias("m"))
    classes = stored(classes.select("key", "m.*", F.monotonically_increasing_id().alias("rep")))
    seen = stored(candidates(classes.select("rep", "sig"), least_agreement(share)))
    pairs, crowd = seen.where("a < b"), seen.where("a = b").select(F.col("a").alias("rep"))
    involved = seen.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    involved = few(stored(classes.select("rep", "id", "text_hash").join(involved, "rep", "left_semi")))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(involved, ["id", "text_hash"]).groupBy("rep").agg(F.min("text").alias("text"))
    texts = stored(texts)
    best = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))).where(f"place <= {FIRST}")
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(confirmed(best, texts, share, shingle))
    roots = components(links)
    apart = stored(across(pairs, roots).select("a", "b"))
    more = stored(confirmed(apart.join(best, ["a", "b"], "left_anti"), texts, share, shingle))
    roots = merged(roots, more)
    failed = stored(across(apart, roots).select("a", "b"))
    centres = towards_centres(failed, links.unionAll(more), roots).join(pairs, ["a", "b"], "left_anti")
    roots = merged(roots, confirmed(centres, texts, share, shingle))
    crowd = crowd.join(roots, crowd["rep"] == roots["node"], "left").select("rep", F.coalesce("root", "rep").alias("root"))
    exact = stored(crowded_pairs(crowd, texts, share, shingle)).join(pairs, ["a", "b"], "left_anti")
    roots = merged(roots, confirmed(exact, texts, share, shingle))
    named = classes.select("key", "id", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("key", "id", "root")
    least = stored(named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")))
    named = named.join(least, "root", "left").select("key", F.coalesce("least", "id").alias("component"))
    of = F.coalesce("component", F.col(id_col))
    return signed.select(id_col, "n_shingles", "key").join(named, "key", "left").select(id_col, "n_shingles", of.alias("component_id"), (of == F.col(id_col)).alias("kept"))
