"""Label propagation and connected components over edge tables (src, dst, weight)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaloom.operators.scan import numbered
from vistaloom.storage import shared_dir, written


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder (spark.checkpoint.dir; one of our own where it is unset)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _vote(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """node, new, gain: the label with the greatest sum of weight * (0.5 + 0.5 * neighbour's quality), rounded to 9 places (ties to the smaller), and by how much that exceeds
    the sum of the node's own label."""
    votes = arcs.join(labels.select(F.col("node").alias("dst"), "label", "quality"), "dst")
    sums = votes.groupBy("src", "label").agg(F.round(F.sum(F.col("weight") * (0.5 + 0.5 * F.col("quality"))), 9).alias("w"))
    own = sums.join(labels.select(F.col("node").alias("src"), F.col("label").alias("own")), "src")
    best = own.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b"), F.max(F.when(F.col("label") == F.col("own"), F.col("w"))).alias("mine"))
    return best.select(F.col("src").alias("node"), (-F.col("b.l")).alias("new"), (F.col("b.w") - F.coalesce("mine", F.lit(0.0))).alias("gain"))


def propagate_rounds(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """node, label after so many synchronous rounds; nodes (node, quality) without edges keep their own."""
    arcs = cut(_both_ways(edges))
    return synchronous(nodes, lambda labels: _vote(labels, arcs), rounds)


def colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, colour: no two neighbours share one. Each pass colours the nodes whose hash is the least among uncoloured neighbours."""
    arcs = cut(_both_ways(edges).select("src", "dst").distinct())
    done = cut(nodes.select("node", F.lit(None).cast("int").alias("colour")))
    rank = F.struct(F.xxhash64("node"), "node")
    while done.where("colour is null").limit(1).count():
        around = arcs.join(done.select(F.col("node").alias("dst"), F.col("colour").alias("c"), F.when(F.col("colour").isNull(), rank).alias("r")), "dst")
        seen = around.groupBy("src").agg(F.min("r").alias("least"), F.collect_set("c").alias("used"))
        now = done.join(seen, done.node == seen.src, "left")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("used"), F.lit(0))), F.coalesce("used", F.array().cast("array<int>"))))
        turn = F.col("colour").isNull() & (F.col("least").isNull() | (rank < F.col("least")))
        done = cut(now.select("node", F.when(turn, free).otherwise(F.col("colour")).alias("colour")))
    return done


def _hindered(movers: DataFrame, arcs: DataFrame) -> DataFrame:
    """node of the movers (node, quality, label, new, gain, rank) that wait: what they gain may be lost to neighbours of lower rank, those whose label they want or who want theirs."""
    a, b = (movers.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{x}") for c in ("quality", "label", "new", "gain", "rank"))) for end, x in (("src", "a"), ("dst", "b")))
    met = arcs.join(a, "src").join(b, "dst").where("rank_b < rank_a AND (new_a = label_b OR new_b = label_a)")
    loss = F.col("weight") * (0.5 + 0.5 * F.col("quality_b")) * F.expr("int(new_a = label_b) + int(new_b = label_a)")
    sums = met.groupBy("src").agg(F.sum(loss).alias("loss"), F.max("gain_a").alias("gain"))
    return sums.where("loss > 0 AND loss >= gain - 1e-9").select(F.col("src").alias("node"))


def synchronous(nodes: DataFrame, vote: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """node, label after so many rounds in which all nodes (node, quality) take what vote(labels) says (node, new); one without a vote keeps its own."""
    labels = nodes.select("node", "quality", F.col("node").alias("label"))
    for _ in range(rounds):
        labels = written(labels.join(vote(labels), "node", "left").select("node", "quality", F.coalesce("new", "label").alias("label")), "labels")
    return labels.select("node", "label")


def settled(nodes: DataFrame, vote: Callable[[DataFrame], DataFrame], hindered: Callable[[DataFrame], DataFrame], max_rounds: int) -> DataFrame:
    """node, label at a fixpoint of vote(labels) (node, new, gain), or after max_rounds.

    In a round all nodes move whose vote differs from their label, but those that hindered(movers) names. Where of two neighbours one wants the label that the other one gives
    up, moving both at once loses their weight (twice, if both do); that counts against the one of higher rank, and who would lose all that it gains waits. Each time that all
    neighbours of a mover count, though some of them wait. So the weight between neighbours of equal label (times both qualities, as in votes) grows with each mover, as in moves one after
    another, and the rounds come to an end. It doesn't take many: in a dense graph few of a node's neighbours are at odds with it. Ranks change with the round.
    """
    labels = nodes.select("node", "quality", F.col("node").alias("label"))
    for n in range(max_rounds):
        asked = written(labels.join(vote(labels), "node", "left").select("node", "quality", "label", F.coalesce("new", "label").alias("new"), "gain"), "asked")
        movers = asked.where("new <> label").select("node", "quality", "label", "new", "gain", F.xxhash64(F.lit(n), "node").alias("rank"))
        if not movers.limit(1).count():
            break
        wait = hindered(movers).select("node", F.lit(True).alias("wait"))
        labels = written(asked.join(wait, "node", "left").select("node", "quality", F.when(F.col("wait"), F.col("label")).otherwise(F.col("new")).alias("label")), "labels")
    return labels.select("node", "label")


def propagate(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, label at a fixpoint (or after max_rounds): see settled()."""
    arcs = cut(_both_ways(edges))
    return settled(nodes, lambda labels: _vote(labels, arcs), lambda movers: _hindered(movers, arcs), max_rounds)


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """arcs (u, v) from u: each u links what it sees (of larger nodes only, if large) with the least of these and itself."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    seen = arcs.join(least, "u")
    if large:
        return seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes, by alternating large and small stars.

    A pass is a few joins and grouped minima, written once to the shared folder; passes grow with the logarithm of the longest chain, and a hub's edges are
    never in one task.
    """
    links = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "links")
    shape = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = written(_star(_star(both, True).distinct(), False).where("u <> v").distinct(), "stars")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == shape:
            break
        shape = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clusters(labels: DataFrame, least: int = 3) -> DataFrame:
    """label, n, cluster_id of labels with enough nodes; cluster_id counts from 0 by size, then label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return numbered(sizes, [F.desc("n"), "label"], "cluster_id")
