"""Centroid clustering by kd-tree filtering: Lloyd's rounds in exact integers.

Vectors with exactly ``dim`` components, none null or not finite, are kept; each component becomes ``floor(scale * x)``.
The ``k`` kept vectors with the smallest lower-case hex SHA-256 of ``seed:id`` are the first centroids, in that order
(all of them, if fewer; of rows that share an id, by their components; null ids last). Each round assigns every vector to
the nearest centroid (squared Euclidean distance; of ties, the smaller number) and moves every centroid that has vectors
to the floor of their mean; then vectors are assigned once more.

Vectors are cut into runs of ``TREE`` rows, each a kd-tree that is written once: its points in tree order and, for each
node, a box and the sum of its points (its count follows from its place). A round reads trees only. It carries each node
with the centroids that can be nearest to any of its points: one that is farther than another from every place of the
box is dropped, a node with a single one left is assigned as a whole, and leaves with several are resolved point by point.
Equal centroids are one, the first. Only sums for each centroid and component are shuffled, and ``k * (dim + 1)`` numbers
reach the driver; vectors aren't shuffled at all, so equal or unevenly spread vectors make no task larger.

Repeated rows count as often as they occur; a null id is kept. An empty table, or one without kept vectors, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import scope, small_batches, to_arrow, written
from sparkloom.llm.vectors import finite, integers, matrix, products

TREE, LEAF = 4096, 32  # points of a tree, and of a leaf, at most


class Tree:
    """A balanced kd-tree: node j of level l holds the points from ``n * j >> l`` to ``n * (j + 1) >> l``, in tree order."""

    def __init__(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.lo, self.hi, self.sums = points, lo, hi, sums
        self.depth = len(lo).bit_length() - 1

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of some points, one at least, and the order that it puts them in."""
        n, order, depth = len(points), np.arange(len(points)), 0
        while (n >> depth) > LEAF:
            for j in range(1 << depth):
                a, b = n * j >> depth, n * (j + 1) >> depth
                own = points[order[a:b]]
                widest = np.argmax(own.max(axis=0) - own.min(axis=0))
                cut = (n * (2 * j + 1) >> (depth + 1)) - a
                order[a:b] = order[a:b][np.argpartition(own[:, widest], cut)]
            depth += 1
        points = points[order]
        begin = np.array([n * j >> depth for j in range(1 << depth)])
        levels = [[f.reduceat(points, begin, axis=0) for f in (np.minimum, np.maximum, np.add)]]
        for _ in range(depth):
            levels.insert(0, [f(x[0::2], x[1::2]) for f, x in zip((np.minimum, np.maximum, np.add), levels[0])])
        return cls(points, *(np.concatenate(x) for x in zip(*levels))), order

    def to_bytes(self) -> list[bytes]:
        return [self.points.astype("<i4").tobytes(), self.lo.astype("<i4").tobytes(), self.hi.astype("<i4").tobytes(), self.sums.astype("<i8").tobytes()]

    @classmethod
    def from_bytes(cls, stored: list[bytes], dim: int) -> Tree:
        points, lo, hi = (np.frombuffer(x, "<i4").reshape(-1, dim).astype(np.int64) for x in stored[:3])
        return cls(points, lo, hi, np.frombuffer(stored[3], "<i8").reshape(-1, dim))


def survivors(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of the centroids ``alive`` for each box, those that aren't farther than another one from every place of the box."""
    out, step = alive.copy(), max(1, (1 << 20) // centers.size)
    squares = (centers * centers).sum(axis=1)
    for a in range(0, len(lo), step):
        part = slice(a, a + step)
        twice, width = lo[part] + hi[part], hi[part] - lo[part]
        near = squares - products(twice, centers)  # distance from the middle, less what all centroids share
        best = np.where(alive[part], near, np.iinfo(np.int64).max).argmin(axis=1)
        # The farther centroid's distance less the nearer one's, at the place of the box where that is least.
        apart = np.abs(centers[best][:, None, :] - centers[None, :, :])
        least = near - near[np.arange(len(best)), best][:, None] - (apart * width[:, None, :]).sum(axis=2)
        out[part] &= ~(least > 0)
    return out


def filtered(tree: Tree, centers: np.ndarray, node: Callable[[int, int, int, int], None], points: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Assign a tree: ``node(place, begin, end, cluster)`` for nodes as a whole, ``points(places, clusters)`` for the rest."""
    n, unique = len(tree.points), np.sort(np.unique(centers, axis=0, return_index=True)[1])
    centers = centers[unique]
    at, alive = np.zeros(1, np.int64), np.ones((1, len(unique)), bool)
    for level in range(tree.depth + 1):
        place = at + (1 << level) - 1
        alive = survivors(tree.lo[place], tree.hi[place], alive, centers)
        one = alive.sum(axis=1) == 1
        for j, c in zip(at[one].tolist(), alive[one].argmax(axis=1).tolist()):
            node(j + (1 << level) - 1, n * j >> level, n * (j + 1) >> level, int(unique[c]))
        at, alive = at[~one], alive[~one]
        if not len(at):
            return
        if level < tree.depth:
            at, alive = np.stack([2 * at, 2 * at + 1], axis=1).ravel(), np.repeat(alive, 2, axis=0)
    begin, end = n * at >> tree.depth, n * (at + 1) >> tree.depth
    places = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
    left = np.flatnonzero(alive.any(axis=0))
    open_ = np.repeat(alive[:, left], end - begin, axis=0)
    far = (centers[left] ** 2).sum(axis=1) - 2 * products(tree.points[places], centers[left])
    points(places, unique[left[np.where(open_, far, np.iinfo(np.int64).max).argmin(axis=1)]])


def totals(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points of a tree each centroid gets, and their sums."""
    counts, sums = np.zeros(len(centers), np.int64), np.zeros_like(centers)

    def node(place: int, begin: int, end: int, cluster: int) -> None:
        counts[cluster] += end - begin
        sums[cluster] += tree.sums[place]

    def points(places: np.ndarray, clusters: np.ndarray) -> None:
        np.add.at(counts, clusters, 1)
        np.add.at(sums, clusters, tree.points[places])

    filtered(tree, centers, node, points)
    return counts, sums


def nearest(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and the squared distance of each point, in tree order."""
    clusters = np.zeros(len(tree.points), np.int32)

    def node(place: int, begin: int, end: int, cluster: int) -> None:
        clusters[begin:end] = cluster

    def points(places: np.ndarray, found: np.ndarray) -> None:
        clusters[places] = found

    filtered(tree, centers, node, points)
    return clusters, ((tree.points - centers[clusters]) ** 2).sum(axis=1)


STORED = ("points", "lo", "hi", "sums")


def trees(vectors: DataFrame, dim: int) -> DataFrame:
    """One row for each kd-tree over ``vectors(id, v)``: the ids in tree order and the tree's arrays as bytes."""
    kind = T.ArrayType(vectors.schema["id"].dataType)
    schema = T.StructType([T.StructField("ids", kind), *(T.StructField(n, T.BinaryType()) for n in STORED)])

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        tree, order = Tree.build(matrix(table.column(1).combine_chunks(), dim))
        ids = table.column(0).combine_chunks().take(pa.array(order))
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in tree.to_bytes())], names=schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, TREE - n)
                held.append(part)
                n, batch = n + len(part), batch.slice(len(part))
                if n == TREE:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return vectors.select("id", "v").mapInArrow(build, schema)


def _stored(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(len(batch)):
        yield batch.column(0).slice(i, 1).flatten(), Tree.from_bytes([batch.column(k)[i].as_py() for k in range(1, 5)], dim)


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256, seed: str = "2"
) -> DataFrame:
    """Return id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one row for each kept vector.

    Other columns of ``vectors`` play no part, whatever they are called.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    given = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vector_col}`"].alias("v"))
    kept = given.where((F.size("v") == dim) & finite(F.col("v"))).select("id", integers(F.col("v"), scale).alias("v"))
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    centers = np.array([r["v"] for r in kept.orderBy(*order).limit(k).collect()], np.int64).reshape(-1, dim)
    with scope() as keep:
        stored = written(trees(kept, dim), "trees")
        for _ in range(rounds if len(centers) else 0):
            counts, sums = _round(stored, centers, dim)
            centers = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centers)
        assigned = keep(written(_assigned(stored, centers, dim, given.schema["id"]), "assigned"))
    spread = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    rows = [(c, d, sum(spread.values()), digests[c]) for c, d in spread.items()]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(stored: DataFrame, centers: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of one assignment over all trees."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((len(centers), dim + 1), np.int64)
        for batch in batches:
            for _, tree in _stored(batch, dim):
                counts, sums = totals(tree, centers)
                whole[:, 0] += counts
                whole[:, 1:] += sums
        own, place = np.nonzero(np.repeat(whole[:, :1] > 0, dim + 1, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(place, pa.int32()), pa.array(whole[own, place])], names=["cluster", "place", "value"])

    parts = stored.mapInArrow(summed, "cluster int, place int, value long")
    whole = np.zeros((len(centers), dim + 1), np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():
        whole[r["cluster"], r["place"]] = r["value"]
    return whole[:, 0], whole[:, 1:]


def _assigned(stored: DataFrame, centers: np.ndarray, dim: int, id_field: T.StructField) -> DataFrame:
    schema = T.StructType([T.StructField("id", id_field.dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _stored(batch, dim):
                clusters, distances = nearest(tree, centers)
                yield pa.RecordBatch.from_arrays([ids, to_arrow(clusters, T.IntegerType()), to_arrow(distances, T.LongType())], names=schema.names)

    return stored.mapInArrow(found, schema)
