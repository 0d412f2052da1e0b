"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaloom.llm.util import saved


#: Nodes that a task holds while it contracts its edges.
HELD = 1 << 19


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (u, v): each node but the least of what hangs together there, with that one. At HELD nodes it begins anew."""
    parent: dict[int, int] = {}  # of all nodes but the least ones

    def root(n: int) -> int:
        while (up := parent.get(n)) is not None:
            parent[n] = n = parent.get(up, up)
        return n

    def held() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([root(n) for n in parent], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            if (p := root(u)) != (q := root(v)):
                parent[max(p, q)] = min(p, q)
        if len(parent) >= HELD:
            yield held()
            parent.clear()
    if parent:
        yield held()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one or edges to larger ones only: stars, which no step changes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
    return not odd.agg(F.count("*")).first()[0]


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """arcs: (u, v) seen from u. Each u links what it sees (of larger ids only, if large) with the least of these and itself."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    seen = arcs.join(least, "u")
    if large:
        return seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    others = seen.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) of each node that has an edge; loops, repeats and nulls count for nothing.

    Each task first contracts the edges it has, so few edges are settled at once. Every pass is a few joins and grouped minima, so a hub's edges are never in one task, and each is written to the shared
    folder; the number of passes grows with the logarithm of the longest chain.
    """
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v").distinct()
    edges = saved(edges.mapInArrow(_forest, "u long, v long"), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _star(both, True).distinct()
        edges = saved(_star(larger, False).where("u != v").distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
