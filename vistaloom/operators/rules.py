"""Rule-based scores, quality gates and top-k with floor and cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_score(x: Column, y: Column) -> Column:
    """1 at the centre (0.5, 0.5) of the unit square, falling with distance."""
    return F.greatest(F.lit(0.0), 1 - 1.5 * F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)))


def position_score_split(x: Column, y: Column) -> Column:
    """0.6 of a horizontal and 0.4 of a vertical score; the latter falls below two thirds of the height."""
    return 0.6 * F.greatest(F.lit(0.0), 1 - 2 * F.abs(x - 0.5)) + 0.4 * F.when(y < 0.67, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - 2 * (y - 0.67)))


def size_score(area_ratio: Column) -> Column:
    return F.least(F.lit(1.0), area_ratio / 0.05)


def likelihood(movement: Column, position: Column, size: Column, audio: Column) -> Column:
    """0.5, 0.25 and 0.25 of the three; energy of active audio adds 0.3 of itself, to 1 at most."""
    base = 0.5 * movement + 0.25 * position + 0.25 * size
    return F.when(audio.isNotNull(), F.least(F.lit(1.0), base + 0.3 * audio)).otherwise(base)


def likelihood_v2(movement: Column, position: Column, size: Column, audio: Column) -> Column:
    base = 0.45 * movement + 0.25 * position + 0.2 * size
    return F.when(audio.isNotNull(), base + 0.1 * F.least(F.lit(1.0), 2 * audio)).otherwise(base)


def gate(rows: DataFrame, rules: dict[str, Column], first: tuple[str, Column] | None = None) -> DataFrame:
    """Adds reason (codes of the rules that hold, in order) and is_valid. If `first` holds, it is the only reason."""
    reasons = F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules.items())))
    if first:
        reasons = F.when(first[1], F.array(F.lit(first[0]))).otherwise(reasons)
    return rows.withColumn("reason", reasons).withColumn("is_valid", F.size("reason") == 0)


def reason_histogram(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def top_with_floor_and_cap(rows: DataFrame, group: str, score: str, key: str, active: Column, loud: tuple[float, int, int], quiet: tuple[float, int, int], cap: int = 8) -> DataFrame:
    """Of each group the rows above a threshold; if fewer than `least` are, the top `floor` instead; `cap` at most.

    loud and quiet are (threshold, least, floor) for groups where `active` holds, or doesn't. Ties go to the smaller key.
    """
    pick = lambda i: F.when(active, loud[i]).otherwise(quiet[i])
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_t", pick(0)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), key)))
    ranked = ranked.withColumn("_k", F.count_if(F.col(score) > F.col("_t")).over(w))
    keep = F.when(F.col("_k") < pick(1), F.col("_r") <= pick(2)).otherwise(F.col(score) > F.col("_t"))
    return ranked.where(keep & (F.col("_r") <= cap)).drop("_t", "_k").withColumnRenamed("_r", "rank")


def largest(rows: DataFrame, group: str, size: str, key: str, least: float, n: int = 5) -> DataFrame:
    """Of each group the n largest of those of at least `least`; ties to the smaller key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(size), key))
    return rows.where(F.col(size) >= least).withColumn("rank", rank).where(F.col("rank") <= n)


def repaired(by_frame: DataFrame, by_center: DataFrame, centers_win_if_better: bool = True) -> DataFrame:
    """frame, center_id, similarity from two sources: by_frame's row, unless by_center's is strictly better (or never, by the other rule)."""
    a = by_frame.groupBy("frame").agg(F.max(F.struct("similarity", (-F.col("center_id")).alias("c"))).alias("a"))
    b = by_center.groupBy("frame").agg(F.max(F.struct("similarity", (-F.col("center_id")).alias("c"))).alias("b"))
    both = a.join(b, "frame", "full")
    better = F.col("a").isNull() | (F.lit(centers_win_if_better) & F.coalesce(F.col("b.similarity") > F.col("a.similarity"), F.lit(False)))
    won = F.when(better, F.col("b")).otherwise(F.col("a"))
    return both.select("frame", (-won["c"]).alias("center_id"), won["similarity"].alias("similarity"))


def mouth_aspect_ratio(mouth: Column) -> Column:
    """Mean of three vertical gaps over the horizontal width, of 20 points (x, y); 0 with fewer points, none, or a width under 1."""
    gap = lambda axis, i, j: F.abs(F.get(mouth, i)[axis] - F.get(mouth, j)[axis])
    ratio = (gap("y", 9, 3) + gap("y", 10, 2) + gap("y", 8, 4)) / 3 / gap("x", 6, 0)
    return F.when(F.coalesce(F.size(mouth), F.lit(0)) < 20, 0.0).when(gap("x", 6, 0) < 1, 0.0).otherwise(ratio)
