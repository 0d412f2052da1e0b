"""Checks before clusters are merged, scores of merges, choice of a method, paging and seeded samples."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaloom.functions.vectors import dot
from vistaloom.operators import graph
from vistaloom.operators.scan import numbered
from vistaloom.operators.vectors import capped_offers, inter_cluster_similarity, overlap_candidates, small_to_large_offers


def _sums(members: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """key and, for each part (a condition), <name>_n, <name>_q (sum of squared norms) and <name>_s (element-wise sum) of its rows."""
    counts = members.groupBy(key).agg(*(x for name, part in parts.items() for x in (F.count_if(part).alias(f"{name}_n"), F.coalesce(F.sum(F.when(part, dot("enc", "enc"))), F.lit(0.0)).alias(f"{name}_q"))))
    places = members.select("*", F.posexplode("enc").alias("place", "x")).groupBy(key, "place").agg(*(F.coalesce(F.sum(F.when(part, F.col("x"))), F.lit(0.0)).alias(name) for name, part in parts.items()))
    taken = lambda name: F.transform("p", lambda x: x[name]).alias(f"{name}_s")
    vectors = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", *parts))).alias("p")).select(key, *map(taken, parts))
    return counts.join(vectors, key)


def _mean_pair(total: Column, squares: Column, n: Column) -> Column:
    """Mean product of two different ones of n vectors, by their sum; 1 for fewer than two."""
    return F.when(n < 2, 1.0).otherwise((dot(total, total) - squares) / (n * (n - 1)))


def merge_safety(members: DataFrame, pairs: DataFrame, threshold: float = 0.35, ratio: float = 0.03, fewest: int = 3, drop: float = 0.08) -> DataFrame:
    """pairs (cluster_i, cluster_j) with c_small, c_union, cross and safe: whether cluster_j may join the target cluster_i.

    It may not if it is tiny beside the target; if its own mean pair (c_small) is below the threshold; if the mean pair of the target's first 30 members (by
    face_id) exceeds that of its first 20 together with cluster_j (c_union) by more than `drop`; or if the mean product across (null where either has one
    member) is below the threshold less 0.05. Means are over all pairs, in place of random samples of them, so results repeat; they come from sums of vectors.
    """
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("face_id")))
    sums = _sums(ranked, "cluster_id", {"all": F.lit(True), "head": F.col("r") <= 30, "first": F.col("r") <= 20})
    side = lambda x: sums.select(*(F.col(c).alias(f"{c}_{x}" if c != "cluster_id" else f"cluster_{x}") for c in sums.columns))
    both = pairs.select("cluster_i", "cluster_j").join(side("i"), "cluster_i").join(side("j"), "cluster_j")
    union = F.zip_with("first_s_i", "all_s_j", lambda x, y: x + y)
    both = both.select(
        "cluster_i", "cluster_j", F.col("all_n_i").alias("n_i"), F.col("all_n_j").alias("n_j"), _mean_pair(F.col("all_s_j"), F.col("all_q_j"), F.col("all_n_j")).alias("c_small"),
        _mean_pair(F.col("head_s_i"), F.col("head_q_i"), F.col("head_n_i")).alias("c_target"), _mean_pair(union, F.col("first_q_i") + F.col("all_q_j"), F.col("first_n_i") + F.col("all_n_j")).alias("c_union"),
        F.when((F.col("all_n_i") > 1) & (F.col("all_n_j") > 1), dot("all_s_i", "all_s_j") / (F.col("all_n_i") * F.col("all_n_j"))).alias("cross"))
    bad = ((F.col("n_j") < ratio * F.col("n_i")) & (F.col("n_j") < fewest)) | (F.col("c_small") < threshold) | (F.col("c_target") - F.col("c_union") > drop) | F.coalesce(F.col("cross") < threshold - 0.05, F.lit(False))
    return both.select("cluster_i", "cluster_j", "c_small", "c_union", "cross", (~bad).alias("safe"))


def merge_small_into_large_safely(members: DataFrame, large: int = 50, small: int = 15, threshold: float = 0.4, cap: int = 10) -> DataFrame:
    """cluster_i (large), cluster_j (small), similarity, faces_added: the safe ones among the offers, `cap` a target by similarity.

    A small cluster whose best target isn't safe joins none, and takes no place of the cap.
    """
    offers = small_to_large_offers(members, large, small, threshold)
    safe = merge_safety(members, offers, threshold).where("safe").select("cluster_i", "cluster_j")
    return capped_offers(offers.join(safe, ["cluster_i", "cluster_j"]), cap)


def merge_overlapping(members: DataFrame, threshold: float = 0.8, first: int = 5) -> DataFrame:
    """cluster_id, merged_id (the smallest id of what it merges with): clusters that overlap in time and whose centres are more similar than threshold
    merge, directly or by way of others, if the mean product of the first members of both (`first` by face_id) exceeds it too."""
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("face_id"))).where(F.col("r") <= first)
    sums = _sums(ranked, "cluster_id", {"first": F.lit(True)})
    side = lambda x: sums.select(F.col("cluster_id").alias(f"cluster_{x}"), F.col("first_n").alias(f"n_{x}"), F.col("first_s").alias(f"s_{x}"))
    met = overlap_candidates(members, threshold).select("cluster_i", "cluster_j").join(side("i"), "cluster_i").join(side("j"), "cluster_j")
    links = met.where(dot("s_i", "s_j") / (F.col("n_i") * F.col("n_j")) > threshold).select(F.col("cluster_i").alias("src"), F.col("cluster_j").alias("dst"))
    merged = graph.components(members.select(F.col("cluster_id").alias("node")).distinct(), links)
    return merged.select(F.col("node").alias("cluster_id"), F.col("component").alias("merged_id"))


def merge_scores(members: DataFrame, small: int = 50, threshold: float = 0.45) -> DataFrame:
    """cluster_i, cluster_j (under `small` faces), score: 0.4 centroid + 0.3 best pair + 0.3 mean pair, above threshold; the best target of each."""
    pairs = inter_cluster_similarity(members)
    both = pairs.unionByName(pairs.select(F.col("cluster_j").alias("cluster_i"), F.col("cluster_i").alias("cluster_j"), "centroid_sim", "mean_sim", "max_sim"))
    sizes = members.groupBy(F.col("cluster_id").alias("cluster_j")).agg(F.count("*").alias("n")).where(F.col("n") < small)
    scored = both.join(sizes, "cluster_j").select("cluster_j", (0.4 * F.col("centroid_sim") + 0.3 * F.col("max_sim") + 0.3 * F.col("mean_sim")).alias("s"), (-F.col("cluster_i")).alias("i"))
    best = scored.where(F.col("s") > threshold).groupBy("cluster_j").agg(F.max(F.struct("s", "i")).alias("b"))
    return best.select((-F.col("b.i")).alias("cluster_i"), "cluster_j", F.col("b.s").alias("score"))


def merge_by_score(members: DataFrame, small: int = 50, threshold: float = 0.45, ratio: float = 0.02, fewest: int = 5, drop: float = 0.15) -> DataFrame:
    """The merges of merge_scores that are safe: cluster_i, cluster_j, score, faces_added.

    One isn't if cluster_j has fewer than `fewest` faces and less than `ratio` of the target's; if its mean pair is below the threshold less 0.1; or if the mean pair of the
    target's first 50 members (by face_id) exceeds that of the first 25 of both by more than `drop`. A small cluster whose best target isn't safe joins none.
    Means are over all pairs, in place of random samples of them.
    """
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("face_id")))
    sums = _sums(ranked, "cluster_id", {"all": F.lit(True), "head": F.col("r") <= 50, "first": F.col("r") <= 25})
    side = lambda x: sums.select(*(F.col(c).alias(f"{c}_{x}" if c != "cluster_id" else f"cluster_{x}") for c in sums.columns))
    both = merge_scores(members, small, threshold).join(side("i"), "cluster_i").join(side("j"), "cluster_j")
    own = _mean_pair(F.col("all_s_j"), F.col("all_q_j"), F.col("all_n_j"))
    target = _mean_pair(F.col("head_s_i"), F.col("head_q_i"), F.col("head_n_i"))
    union = F.zip_with("first_s_i", "first_s_j", lambda x, y: x + y)
    after = _mean_pair(union, F.col("first_q_i") + F.col("first_q_j"), F.col("first_n_i") + F.col("first_n_j"))
    tiny = (F.col("all_n_j") < ratio * F.col("all_n_i")) & (F.col("all_n_j") < fewest)
    safe = both.where(~tiny & (own >= threshold - 0.1) & (target - after <= drop))
    return safe.select("cluster_i", "cluster_j", "score", F.col("all_n_j").alias("faces_added"))


def choose_method(sizes: DataFrame) -> DataFrame:
    """sizes (method original or adjusted, n a cluster) -> chosen: adjusted if it has 0.7 of the clusters at most, or no more of them at 0.8 of the dispersion."""
    per = sizes.groupBy("method").agg(F.count("*").alias("k"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    one = per.agg(*(F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{c}_{m}") for m in ("original", "adjusted") for c in ("k", "cv")))
    better = (F.col("k_adjusted") <= 0.7 * F.col("k_original")) | ((F.col("k_adjusted") <= F.col("k_original")) & (F.col("cv_adjusted") < 0.8 * F.col("cv_original")))
    return one.select(F.when(F.coalesce(better, F.lit(False)), "adjusted").otherwise("original").alias("chosen"))


def pages(rows: DataFrame, key: str, size: int = 16) -> DataFrame:
    """Adds page (from 0) in the order of key."""
    return numbered(rows, [key], "_n").withColumn("page", F.expr(f"int(_n div {size})")).drop("_n")


def seeded_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in the order of a seeded hash of key: the same ones each time."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def center_summary(matches: DataFrame, least: int = 3) -> DataFrame:
    """center_id, n, mean similarity of centres with `least` matches or more."""
    return matches.groupBy("center_id").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean")).where(F.col("n") >= least)


def _follow(radius: float, frames: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, seen, n = object(), {}, 0  # seen: track -> frame, x, y
        for batch in batches:
            out = []
            for v, frame, x, y in zip(*(batch.column(c).to_pylist() for c in ("video", "frame", "x", "y"))):
                if v != video:
                    video, seen, n = v, {}, 0
                seen = {t: p for t, p in seen.items() if None not in (frame, p[0]) and frame - p[0] <= frames}
                near = [(math.hypot(x - p[1], y - p[2]), t) for t, p in seen.items() if frame > p[0] and None not in (x, y, *p)]
                near = [z for z in near if z[0] < radius]
                track = min(near)[1] if near else n
                n += not near
                seen[track] = (frame, x, y)
                out.append(track)
            yield pa.record_batch([batch.column("video"), batch.column("id"), pa.array(out, pa.int32())], ["video", "id", "track"])

    return run


def follow(rows: DataFrame, radius: float = 50.0, frames: int = 10) -> DataFrame:
    """rows (video, frame, id, x, y) with track: the closest earlier face within radius, at most `frames` back, lends its track; else a new one starts.

    A face's track depends on those given before, so a video's rows pass in order through one task; what is kept is the last
    place of each track seen within `frames`.
    """
    cast = [F.col("frame").cast("int").alias("frame"), "id", *(F.col(c).cast("double").alias(c) for c in "xy")]
    dealt = rows.select("video", *cast).repartition("video").sortWithinPartitions("video", "frame", "id", "x", "y")
    schema = T.StructType([dealt.schema["video"], dealt.schema["id"], T.StructField("track", T.IntegerType())])
    return dealt.mapInArrow(_follow(radius, frames), schema)


def _follow_first(radius: float, frames: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, live, number = object(), {}, {}
        for batch in batches:
            out = []
            for v, frame, x, y in zip(*(batch.column(c).to_pylist() for c in ("video", "frame", "x", "y"))):
                if v != video:
                    video, live, number = v, {}, {}
                if None in (frame, x, y):
                    out.append(None)
                    continue
                live = {t: p for t, p in live.items() if frame - p[0] <= frames}
                near = [t for t, p in live.items() if math.hypot(x - p[1], y - p[2]) < radius]
                track = min(near, key=number.__getitem__) if near else f"{int(x)}_{int(y)}"
                number.setdefault(track, len(number))
                live[track] = (frame, x, y)
                out.append(track)
            yield pa.record_batch([batch.column("video"), batch.column("id"), pa.array(out, pa.string())], ["video", "id", "track"])

    return run


def follow_first(rows: DataFrame, radius: float = 50.0, frames: int = 10) -> DataFrame:
    """rows (video, frame, id, x, y) with track: the first track, by when it began, whose last place is within radius and at most `frames` back; else a new one, named by its place.

    Faces of one frame may share a track. A track that begins anew at the whole place of an old one goes on under its name and rank. A null frame or place has no track. As in follow(), a
    video's rows pass in order through one task; what is kept is bounded by the places of a picture.
    """
    cast = [F.col("frame").cast("int").alias("frame"), "id", *(F.col(c).cast("double").alias(c) for c in "xy")]
    dealt = rows.select("video", *cast).repartition("video").sortWithinPartitions("video", "frame", "id", "x", "y")
    schema = T.StructType([dealt.schema["video"], dealt.schema["id"], T.StructField("track", T.StringType())])
    return dealt.mapInArrow(_follow_first(radius, frames), schema)


def networks(members: DataFrame, most: int = 30, least: int = 3) -> DataFrame:
    """cluster_id, src < dst, similarity: all pairs of a cluster's first `most` members by face_id, of clusters of `least` members or more."""
    ranked = members.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("face_id"))).where(F.col("_r") <= most)
    sizes = ranked.groupBy("cluster_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    own = ranked.join(sizes, "cluster_id").select("cluster_id", F.col("face_id").alias("src"), F.col("enc").alias("a"))
    return own.join(own.select("cluster_id", F.col("src").alias("dst"), F.col("a").alias("b")), "cluster_id").where("src < dst").select("cluster_id", "src", "dst", dot("a", "b").alias("similarity"))
