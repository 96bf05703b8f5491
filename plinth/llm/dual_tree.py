"""Lloyd's k-means on integer vectors, each round by two trees: a cover tree over each block of vectors, built
once, and one over the centroids of the round.

A node of a cover tree is a ball around one of its vectors. Its children are balls of half its radius whose centres are
more than that apart (farthest first); a node whose vectors are few or all equal, or which no few such balls cover (vectors
without structure), is a leaf. A node of vectors goes down together with the nodes of centroids that may hold the
nearest one of any of its vectors: by the triangle inequality, nodes whose nearest possible centroid is farther than the farthest
possible distance to another one are pruned. If one centroid is left, all vectors of the node are its, by the
node's sums, without a look at them; at leaves the vectors are compared with the centroids that are left, exactly.

Blocks of BLOCK vectors and their trees are stored as rows, so Spark spreads the work by blocks and no task holds more than one.
A round sums up every task's sums and counts per cluster; the driver sees a row per cluster and component. Bounds are floating-point
with some slack; distances, sums and floors are exact integers. Equal distances go to the smaller number.

Vectors that don't have exactly ``dim`` components, or have one that is null, NaN or infinite, aren't kept. Components are taken as
floor(256 x) between -LIMIT and LIMIT, so that distances fit a long. A null id is kept, but starts no centroid as long as others are there. Rows
that repeat an id or a vector are rows of their own; one vector in a third of all rows is a node of radius 0. With fewer vectors than
``k`` there are as many centroids; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import arrow_map, stored

BLOCK, LEAF = 4096, 24
LIMIT = 1 << 27
#: Values up to which sums of 64 products are exact in floating point.
SMALL = 1 << 22


@dataclass
class Tree:
    """Nodes in the order in which they were made, the root first. ``order``: the points; a node holds those from
    ``start`` to ``end``; its centre is the first of them. Children lie from ``child`` on, ``children`` of them."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(points: np.ndarray, leaf: int = LEAF, *, fine: bool = False) -> Tree:
    """``fine``: nodes are split whatever that takes; with ``leaf`` 1 and different points down to each point."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    nodes, to_do = [[0, len(points), 0, 0, 0.0]], [0] * bool(len(points))
    while to_do:
        at = to_do.pop()
        start, end = nodes[at][:2]
        own = order[start:end]
        nearest, which, centres = distances(points[own], points[own[0]]), np.zeros(len(own), np.int64), [0]
        radius = nodes[at][4] = float(nearest.max())
        most = len(own) if fine else max(4, len(own) // 8)
        if len(own) <= leaf or radius == 0:
            continue
        while nearest.max() > radius / 2 and len(centres) <= most:
            new = int(nearest.argmax())
            gap = distances(points[own], points[own[new]])
            closer = gap < nearest
            which[closer], nearest = len(centres), np.where(closer, gap, nearest)
            centres.append(new)
        if len(centres) > most:
            continue
        rank = np.ones(len(own), np.int64)
        rank[centres] = 0  # a child's centre comes first
        sort = np.lexsort((rank, which))
        order[start:end] = own[sort]
        bounds = start + np.searchsorted(which[sort], np.arange(len(centres) + 1))
        nodes[at][2:4] = [len(nodes), len(centres)]
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            to_do.append(len(nodes))
            nodes.append([first, last, 0, 0, 0.0])
    table = np.array([n[:4] for n in nodes], np.int64)
    return Tree(order, *table.T, np.array([n[4] for n in nodes]))


def nearest_exact(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The first of the nearest centroids of each point, all integers."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL else np.int64
    c = centroids.astype(kind)
    return ((c * c).sum(axis=1) - 2 * (points.astype(kind) @ c.T)).argmin(axis=1)


@dataclass
class Work:
    """Pairs of a vector and a centroid that were compared, and those that there are."""

    compared: int = 0
    pairs: int = 0


def assigned(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree, work: Work | None = None) -> list[tuple[int, int, int | np.ndarray]]:
    """``points`` lie in the order of their tree. (from, to, centroid or an array of them), which cover all points."""
    middle = points[tree.start].astype(np.float64)
    heads = over.order[over.start]  # the centroid at the middle of each node of centroids
    reps = centroids[heads].astype(np.float64)
    out, to_do = [], [(0, np.zeros(1, np.int64))]
    if work:
        work.pairs += len(points) * len(centroids)
    while to_do:
        node, near = to_do.pop()
        start, end, radius = int(tree.start[node]), int(tree.end[node]), tree.radius[node]
        whole = tree.children[node] == 0
        while True:
            gap = distances(reps[near], middle[node])
            bound = gap.min() + 2 * radius
            keep = gap - over.radius[near] <= bound + 1e-9 * bound + 1e-6
            near = near[keep]
            wide = over.end[near] - over.start[near] > 1
            large = wide & ((over.radius[near] >= radius) | whole)
            if not large.any():
                break
            near = np.concatenate([near[~large], *(np.arange(over.child[i], over.child[i] + over.children[i]) for i in near[large])])
        if len(near) == 1 and not wide.any():
            out.append((start, end, int(heads[near[0]])))
        elif whole:
            these = np.sort(heads[near])
            if work:
                work.compared += (end - start) * len(these)
            out.append((start, end, these[nearest_exact(points[start:end], centroids[these])]))
        else:
            to_do += [(i, near) for i in range(tree.child[node], tree.child[node] + tree.children[node])]
    return out


class Centroids:
    """The centroids of a round and their tree. Of equal ones only the smallest number can win, so only that is in it."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = np.array(rows, np.int64)
        self.numbers = np.sort(np.unique(self.rows, axis=0, return_index=True)[1])
        self.different = self.rows[self.numbers]
        self.tree = cover_tree(self.different, 1, fine=True)

    def of(self, points: np.ndarray, tree: Tree, work: Work | None = None) -> Iterator[tuple[int, int, int | np.ndarray]]:
        """For ranges of the points, in their tree's order: the number of the nearest centroid, or one for each."""
        for start, end, found in assigned(points, tree, self.different, self.tree, work):
            yield start, end, self.numbers[found]


PACKED = "ids array<{id}>, vectors binary, tree binary, radius binary, sums binary"


def blocks(vectors: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """``vectors``: (id, array of ``dim`` doubles). A row for each block: ids and integer vectors in the order of the block's
    cover tree, the tree, and the sum of the vectors of each node."""
    kind = vectors.schema[0].dataType.simpleString()

    def pack(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(parts)
        tree = cover_tree(points)
        points = points[tree.order]
        total = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])
        nodes = np.stack([tree.start, tree.end, tree.child, tree.children])
        column = pa.concat_arrays(ids).take(pa.array(tree.order))
        lists = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        raw = [np.ascontiguousarray(x).tobytes() for x in (points.astype(np.int32), nodes, tree.radius, total[tree.end] - total[tree.start])]
        return pa.RecordBatch.from_arrays([lists, *(pa.array([x], pa.binary()) for x in raw)], ["ids", "vectors", "tree", "radius", "sums"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            whole = np.clip(np.floor(256 * np.clip(values, -LIMIT, LIMIT)), -LIMIT, LIMIT).astype(np.int64)
            for at in range(0, len(whole), size):
                if held + len(whole[at : at + size]) > size:
                    yield pack(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(batch.column(0)[at : at + size])
                parts.append(whole[at : at + size])
                held += len(parts[-1])
        if held:
            yield pack(ids, parts)

    return arrow_map(vectors, build, PACKED.format(id=kind))


def unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree, np.ndarray]]:
    of = lambda c, i, kind: np.frombuffer(batch.column(batch.schema.names.index(c))[i].as_buffer(), kind)
    for i in range(batch.num_rows):
        points = of("vectors", i, np.int32).reshape(-1, dim).astype(np.int64)
        nodes = of("tree", i, np.int64).reshape(4, -1)
        ids = batch.column(batch.schema.names.index("ids"))[i].values if "ids" in batch.schema.names else None
        yield ids, points, Tree(np.arange(len(points)), *nodes, of("radius", i, np.float64)), of("sums", i, np.int64).reshape(-1, dim)


def moved(packed: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The next round's centroids: the floors of the means of their vectors; those without vectors stay."""
    dim = len(centroids[0])
    shared = packed.sparkSession.sparkContext.broadcast(Centroids(centroids))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        total = np.zeros((len(near.rows), dim + 1), np.int64)
        for batch in batches:
            for _, points, tree, sums in unpacked(batch, dim):
                node = {(a, b): i for i, (a, b) in enumerate(zip(tree.start.tolist(), tree.end.tolist(), strict=True))}
                for start, end, found in near.of(points, tree):
                    if np.ndim(found) == 0:  # a whole node
                        total[found, :dim] += sums[node[start, end]]
                        total[found, dim] += end - start
                    else:
                        np.add.at(total[:, :dim], found, points[start:end])
                        total[:, dim] += np.bincount(found, minlength=len(total))
        some = np.flatnonzero(total[:, dim])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1), len(some)).astype(np.int32)), pa.array(total[some].ravel())], ["cluster", "place", "total"])

    rows = arrow_map(packed.drop("ids"), add, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[int, dict[int, int]] = {}
    for r in rows.collect():
        found.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
    return [[found[c][j] // found[c][dim] for j in range(dim)] if c in found else old for c, old in enumerate(centroids)]


def labelled(packed: DataFrame, centroids: list[list[int]], id_col: str) -> DataFrame:
    """(id, ``cluster`` int, ``distance`` long, squared) of each vector."""
    dim, kind = len(centroids[0]), packed.schema["ids"].dataType.elementType.simpleString()
    shared = packed.sparkSession.sparkContext.broadcast(Centroids(centroids))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            for ids, points, tree, _ in unpacked(batch, dim):
                cluster = np.zeros(len(points), np.int32)
                for start, end, found in near.of(points, tree):
                    cluster[start:end] = found
                gap = points - near.rows[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array((gap * gap).sum(axis=1))], [id_col, "cluster", "distance"])

    return arrow_map(packed, label, f"`{id_col}` {kind}, cluster int, distance long")


def clusters(vectors: DataFrame, *, k: int, rounds: int, dim: int, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: id, ``cluster``, ``distance`` (squared, to its centroid), ``cluster_inertia`` and ``inertia``
    (distances summed over its cluster and over all), ``centroid_sha256``. The first centroids are the ``k`` vectors with the smallest
    sha256 of ``seed:id``."""
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is greater than all
    kept = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where((F.size("_v") == dim) & F.forall("_v", finite))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = kept.orderBy(draw.asc_nulls_last(), "_v").limit(k).collect()
    if not first:
        empty = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    floor = lambda x: int(np.clip(np.floor(256 * min(max(x, -LIMIT), LIMIT)), -LIMIT, LIMIT))
    centroids = [[floor(x) for x in r["_v"]] for r in first]
    packed = stored(blocks(kept, dim))
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    found = stored(labelled(packed, centroids, id_col))
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)], "cluster int, centroid_sha256 string")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    as_long = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    inertia = found.groupBy("cluster").agg(as_long(whole).alias("cluster_inertia")).join(digests, "cluster")
    return found.join(F.broadcast(inertia), "cluster").withColumn("inertia", found.select(as_long(whole)).scalar()).select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
