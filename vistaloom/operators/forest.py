"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the vectors again and again: a node's plane stands upright on the line between two of its members, drawn by a
hash, and passes through the median of their projections. All trees grow level by level, two Spark jobs a level: the first draws the members of all nodes at
once, the second finds the medians by mergeable sketches. Planes are grown on a sample of FIT vectors at most, drawn by a hash, so they have a bound and are
broadcast; every vector is indexed. A vector's cells (a leaf of each tree) are rows of the index.

A query descends best first over all trees together: of the nodes on its wrong side, the one nearest to its plane is the next to be
opened, until the cells opened hold as many entries as it may look at. Queries meet the entries of a cell by a shuffle on the cell, where a task
multiplies matrices and keeps each query's best; no query meets all vectors, and no side is broadcast but for the planes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaloom.storage import written

#: Vectors the planes are grown on at most; trees; vectors of a leaf; entries that a query looks at.
FIT, TREES, LEAF, LOOKED_AT = 1 << 16, 16, 32, 2400


@dataclass
class Tree:
    """Planes by node: where node i has a plane, its children are left[i] (beneath) and left[i] + 1; else left[i] is -1."""

    normal: list = field(default_factory=lambda: [None])
    offset: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])

    def split(self, node: int, normal: np.ndarray, offset: float) -> tuple[int, int]:
        at = len(self.left)
        self.normal[node], self.offset[node], self.left[node] = normal, offset, at
        self.normal += [None, None]
        self.offset += [0.0, 0.0]
        self.left += [-1, -1]
        return at, at + 1


class Forest:
    """The trees as arrays, to be broadcast. sizes: entries in each leaf."""

    def __init__(self, trees: list[Tree], places: int):
        self.left = [np.array(t.left) for t in trees]
        self.offset = [np.array(t.offset) for t in trees]
        self.normal = [np.stack([np.zeros(places) if x is None else x for x in t.normal]) for t in trees]
        self.sizes = [np.zeros(len(t.left), np.int64) for t in trees]

    def leaves(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector."""
        left, at = self.left[tree], np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(left[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            over = np.einsum("ij,ij->i", vectors[inner], self.normal[tree][node]) > self.offset[tree][node]
            at[inner] = left[node] + over

    def opened(self, vector: np.ndarray, looked_at: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves that a best-first descent opens."""
        heap, out, entries = [(-np.inf, t, 0) for t in range(len(self.left))], [], 0
        while heap and entries < looked_at:
            margin, t, node = heapq.heappop(heap)
            while (child := self.left[t][node]) >= 0:
                gap = float(vector @ self.normal[t][node]) - self.offset[t][node]
                heapq.heappush(heap, (max(margin, abs(gap)), t, int(child + (gap <= 0))))
                node = int(child + (gap > 0))
            if self.sizes[t][node]:
                out.append((t, node))
                entries += int(self.sizes[t][node])
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix, from the list's flat values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _drawn(shared):
    """Of each open node: how many vectors a task has there, and those with the least and the largest hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, open_ = shared.value
        best: dict = {}
        for batch in batches:
            vectors, h = matrix(batch.column("enc")), batch.column("h").to_numpy()
            for t in range(len(open_)):
                at = forest.leaves(vectors, t)
                own = h * (2 * t + 1)  # another order in each tree; wraps around
                for node in np.intersect1d(np.unique(at), open_[t]).tolist():
                    some = np.flatnonzero(at == node)
                    low, high = some[own[some].argmin()], some[own[some].argmax()]
                    now = best.setdefault((t, node), [0, None, None])
                    now[0] += len(some)
                    if now[1] is None or own[low] < now[1][0]:
                        now[1] = (int(own[low]), vectors[low])
                    if now[2] is None or own[high] > now[2][0]:
                        now[2] = (int(own[high]), vectors[high])
        if best:
            rows = [(t, n, c, a[0], a[1].tolist(), b[0], b[1].tolist()) for (t, n), (c, a, b) in best.items()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["tree", "node", "n", "low", "a", "high", "b"])

    return run


def _projected(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, normals = shared.value
        for batch in batches:
            vectors = matrix(batch.column("enc"))
            for t in range(len(forest.left)):
                at = forest.leaves(vectors, t)
                for node in [n for n in np.unique(at).tolist() if (t, n) in normals]:
                    own = vectors[at == node] @ normals[t, node]
                    yield pa.record_batch([pa.array(np.full(len(own), t, np.int32)), pa.array(np.full(len(own), node)), pa.array(own)], ["tree", "node", "x"])

    return run


def grow(items: DataFrame, trees: int = TREES, leaf: int = LEAF, fit: int = FIT) -> Forest:
    """A forest over items (id, enc: vectors of equal length). Equal vectors can't be parted, so a leaf of copies may be larger."""
    spark = items.sparkSession
    n = items.count()
    keyed = items.select("enc", F.xxhash64(F.lit(1), "id").alias("h"))
    if n > fit:
        keyed = keyed.where(F.col("h") < int(-(2**63) + fit / n * 2**64)).limit(2 * fit)
    sample = written(keyed, "forest-sample")
    first = sample.first()
    places = len(first.enc) if first else 0
    grown = [Tree() for _ in range(trees)]
    open_ = [[0] for _ in grown]
    while places and any(open_):
        shared = spark.sparkContext.broadcast((Forest(grown, places), open_))
        vector = "array<double>"
        drawn = sample.mapInArrow(_drawn(shared), f"tree int, node long, n long, low long, a {vector}, high long, b {vector}").groupBy("tree", "node").agg(F.sum("n").alias("n"), F.min_by("a", "low").alias("a"), F.max_by("b", "high").alias("b")).collect()
        normals = {}
        for r in drawn:  # a row for each open node, of which the sample bounds the number
            gap = np.array(r.b) - np.array(r.a)
            if r.n > leaf and np.linalg.norm(gap) > 0:
                normals[r.tree, r.node] = gap / np.linalg.norm(gap)
        open_ = [[] for _ in grown]
        if normals:
            halves = sample.mapInArrow(_projected(spark.sparkContext.broadcast((shared.value[0], normals))), "tree int, node long, x double").groupBy("tree", "node").agg(F.percentile_approx("x", 0.5, 1000).alias("m"), F.max("x").alias("most"), F.min("x").alias("least")).collect()
            for r in halves:
                middle = r.m if r.m < r.most else (r.least + r.most) / 2
                open_[r.tree] += grown[r.tree].split(r.node, normals[r.tree, r.node], middle)
    return Forest(grown, places)


def _cells(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            vectors = matrix(batch.column("enc"))
            for t in range(len(forest.left)):
                yield pa.record_batch([pa.array(np.full(len(vectors), t, np.int32)), pa.array(forest.leaves(vectors, t)), batch.column("id"), batch.column("enc")], ["tree", "node", "id", "enc"])

    return run


def _openings(shared, looked_at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for i, vector in enumerate(matrix(batch.column("enc"))):
                cells = forest.opened(vector, looked_at)
                if cells:
                    at = pa.array(np.full(len(cells), i))
                    yield pa.record_batch([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int64()), batch.column("id").take(at), batch.column("enc").take(at)], ["tree", "node", "id", "enc"])

    return run


def _best(k: int):
    """Of rows sorted by cell, its entries (side 0) ahead of its queries: (query, id, similarity) of each query's k most similar entries (ties: smallest id)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held = None, [], []
        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist(), batch.column("side").to_pylist()))
            vectors, own = matrix(batch.column("enc")), batch.column("id").to_numpy()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a][:2] != cell:
                    cell, ids, held = keys[a][:2], [], []
                if keys[a][2] == 0:
                    ids.append(own[a:b])
                    held.append(vectors[a:b])
                elif ids:
                    entries = np.concatenate(ids)
                    products = vectors[a:b] @ np.concatenate(held).T
                    for query, s in zip(own[a:b].tolist(), products):
                        top = np.lexsort((entries, -s))[:k]
                        yield pa.record_batch([pa.array(np.full(len(top), query)), pa.array(entries[top]), pa.array(s[top])], ["query", "id", "similarity"])

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int, looked_at: int = LOOKED_AT, trees: int = TREES, leaf: int = LEAF, fit: int = FIT) -> DataFrame:
    """query, id, similarity, rank: about the k items (id, enc) most similar to each query (id, enc), by the dot product; ties go to the smaller id.

    A query looks at `looked_at` entries and what the last leaf holds beyond that; an item may be among them once a tree. With no more items than a leaf holds the
    result is exact. Beyond `fit` items leaves grow with them. Ids are longs; rows with null vectors must be left out. Without items there are no rows.
    """
    spark = items.sparkSession
    ids = [F.col("id").cast("long").alias("id"), F.col("enc").cast("array<double>").alias("enc")]
    items, queries = items.select(*ids), queries.select(*ids)
    forest = grow(items, trees, leaf, fit)
    if not forest.normal[0].shape[1]:
        return queries.limit(0).select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    if len(forest.left[0]) == 1:  # one leaf holds all
        forest = Forest([Tree()], forest.normal[0].shape[1])
    schema = "tree int, node long, id long, enc array<double>"
    cells = written(items.mapInArrow(_cells(spark.sparkContext.broadcast(forest)), schema), "forest-cells")
    for r in cells.groupBy("tree", "node").agg(F.count("*").alias("n")).collect():  # a row for each leaf, of which the sample bounds the number
        forest.sizes[r.tree][r.node] = r.n
    asked = queries.mapInArrow(_openings(spark.sparkContext.broadcast(forest), looked_at), schema)
    both = cells.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)))
    met = both.repartition("tree", "node").sortWithinPartitions("tree", "node", "side").mapInArrow(_best(k), "query long, id long, similarity double")
    found = met.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
