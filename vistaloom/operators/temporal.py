"""Ordered operators over observations of tracks: votes, smoothing, speech segments, intervals, nearest in time.

Smoothing and sliding means are scans over ranges of rows, so a long track is many tasks' work. Where a later row depends on
earlier decisions, a track's rows are folded in order with aggregate() over a sorted array; windows by track do the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaloom.operators.intervals import means_around, points_in_intervals
from vistaloom.operators.quantiles import quantiles
from vistaloom.operators.scan import affine, exponential, sliding
from vistaloom.storage import written

ORDER = ["ts", "event_id"]


def by_track() -> Window:
    return Window.partitionBy("track").orderBy(*ORDER)


def history_vote(rows: DataFrame, size: int = 10, least: int = 3) -> DataFrame:
    """rows (track, ts, event_id, match, similarity) with filled_match, filled_similarity, from_history.

    A row without a good match (below 0 or under 0.5) takes the commonest match of the size - 1 rows before it, among
    those at least 0.45 similar, if it has `least` votes and so many rows were seen; ties go to the first seen.
    """
    before = by_track().rowsBetween(-(size - 1), -1)
    seen = F.collect_list(F.when((F.col("match") >= 0) & (F.col("similarity") >= 0.45), F.col("match"))).over(before)
    count = F.count("*").over(by_track().rowsBetween(-(size - 1), 0))
    rows = rows.withColumn("_seen", seen).withColumn("_n", count)
    votes = F.transform(F.array_distinct("_seen"), lambda m: F.struct(F.size(F.filter("_seen", lambda x: x == m)).alias("votes"), (-F.array_position("_seen", m)).alias("first"), m.alias("match")))
    rows = rows.withColumn("_top", F.array_max(votes))
    fill = ((F.col("match") < 0) | (F.col("similarity") < 0.5)) & (F.col("_n") >= least) & (F.col("_top.votes") >= least)
    fill = F.coalesce(fill, F.lit(False))
    return rows.select("track", "event_id", F.when(fill, F.col("_top.match")).otherwise(F.col("match")).alias("filled_match"), F.when(fill, F.greatest("similarity", F.lit(0.4))).otherwise(F.col("similarity")).alias("filled_similarity"), fill.alias("from_history"))


def _folded(rows: DataFrame, columns: list[str], start: Column, step, result: str) -> DataFrame:
    """track, event_id, result: a fold over a track's rows. step(state, row) gives the new state, whose `out` is appended."""
    held = rows.groupBy("track").agg(F.array_sort(F.collect_list(F.struct(*ORDER, *columns))).alias("rows"))
    folded = F.aggregate("rows", start, step)
    return held.select("track", F.explode(F.arrays_zip(F.col("rows.event_id").alias("event_id"), folded["outs"].alias(result))).alias("x")).select("track", "x.*")


def _smoothed(value: Column, alpha: float) -> tuple[Column, Column, Column]:
    """The step of exponential smoothing: the first value as it is, then alpha * value + (1 - alpha) * last; a null holds the last."""
    none = value.isNull()
    return F.when(none, 1.0).otherwise(round(1 - alpha, 12)), F.when(none, 0.0).otherwise(alpha * value), value


def ema(rows: DataFrame, alpha: float = 0.3, value: str = "value") -> DataFrame:
    """track, event_id, smooth: alpha * value + (1 - alpha) * last, from the first value on; a null holds the last."""
    return affine(rows, ["track"], ORDER, {"smooth": _smoothed(F.col(value), alpha)}).select("track", "event_id", "smooth")


def smooth_boxes(rows: DataFrame, alpha: float = 0.3, sides: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """track, event_id and each side of a box, smoothed as in ema() and only then rounded, halves to the even number; rows without a box hold the last one."""
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in sides)) == 1
    # Rounding shows the last bit of a half, so the arithmetic is that of a loop.
    out = exponential(rows.select("track", *ORDER, *sides), ["track"], ORDER, {f"_{c}": F.when(~missing, F.col(c)) for c in sides}, alpha)
    return out.select("track", "event_id", *(F.rint(f"_{c}").cast("int").alias(c) for c in sides))


def feedback_boost(rows: DataFrame, weight: float = 0.3, size: int = 5, threshold: float = 0.5) -> DataFrame:
    """track, event_id, adjusted: (1 - weight) * value + weight * mean of the last `size` accepted; accepted, if above threshold, joins them."""
    start = F.struct(F.array().cast("array<double>").alias("h"), F.array().cast("array<double>").alias("outs"))

    def step(state, row):
        mean = F.aggregate(state["h"], F.lit(0.0), lambda a, x: a + x) / F.size(state["h"])
        now = F.when(F.size(state["h"]) > 0, (1 - weight) * row["value"] + weight * mean).otherwise(row["value"])
        grown = F.when(now > threshold, F.slice(F.concat(F.array(now), state["h"]), 1, size)).otherwise(state["h"])
        return F.struct(grown.alias("h"), F.concat(state["outs"], F.array(now)).alias("outs"))

    return _folded(rows, ["value"], start, step, "adjusted")


def energy_smoothing(rows: DataFrame, share: float = 0.7, size: int = 10) -> DataFrame:
    """track, event_id, smooth, mean: share * value + (1 - share) * last smooth, and its mean over the last `size` rows."""
    smooth = affine(rows.select("track", *ORDER, "value"), ["track"], ORDER, {"smooth": _smoothed(F.col("value"), share)})
    return sliding(smooth, ["track"], ORDER, size - 1, {"mean": lambda w: F.avg("smooth").over(w)}).select("track", "event_id", "smooth", "mean")


def loudest_face(faces: DataFrame, share: float = 0.7, size: int = 10) -> DataFrame:
    """video, frame_num, face_idx, face, mean: of each frame's faces (video, frame_num, face_idx, face, energy: null while nobody speaks) the one with the largest mean.

    The energy of a face is smoothed over the frames that it is in while somebody speaks (energy_smoothing), and mean is over its last `size` ones. Ties go to
    the lower face_idx; a mean that isn't above 0 names nobody.
    """
    heard = faces.where("energy IS NOT NULL").select("video", "face", "frame_num", "face_idx", F.col("energy").alias("value"))
    order = ["frame_num", "face_idx"]
    smooth = affine(heard, ["video", "face"], order, {"smooth": _smoothed(F.col("value"), share)})
    means = sliding(smooth, ["video", "face"], order, size - 1, {"mean": lambda w: F.avg("smooth").over(w)})
    # A face that is in a frame twice counts with all its values of that frame.
    after = means.groupBy("video", "frame_num", "face").agg(F.max_by("mean", "face_idx").alias("mean"), F.min("face_idx").alias("face_idx"))
    best = after.where("mean > 0").groupBy("video", "frame_num").agg(F.max(F.struct("mean", (-F.col("face_idx")).alias("i"), "face")).alias("b"))
    return best.select("video", "frame_num", (-F.col("b.i")).alias("face_idx"), "b.face", "b.mean")


def thresholds(rows: DataFrame) -> DataFrame:
    """track, mean_std (mean + 0.5 * population std), mad_3 and mad_25 (median + 3 or 2.5 times the median absolute deviation)."""
    base = rows.groupBy("track").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    middle = written(quantiles(rows, ["track"], "value", [0.5]).withColumnRenamed("q0", "median"), "medians")
    off = quantiles(rows.join(middle, "track").select("track", F.abs(F.col("value") - F.col("median")).alias("off")), ["track"], "off", [0.5]).withColumnRenamed("q0", "mad")
    both = base.join(middle, "track").join(off, "track")
    return both.select("track", (F.col("mean") + 0.5 * F.col("std")).alias("mean_std"), (F.col("median") + 3 * F.col("mad")).alias("mad_3"), (F.col("median") + 2.5 * F.col("mad")).alias("mad_25"))


def islands(rows: DataFrame, active: Column) -> DataFrame:
    """rows with active, and island: a number for each run of active rows (null where inactive)."""
    rows = rows.withColumn("active", active)
    edge = F.when(F.col("active") & ~F.coalesce(F.lag("active").over(by_track()), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_edge", edge)
    return rows.withColumn("island", F.when(F.col("active"), F.sum("_edge").over(by_track()))).drop("_edge")


def segments(rows: DataFrame, active: Column, end_rule: str = "last_active", keep_tail: bool = True, least_s: float = 0.0) -> DataFrame:
    """track, island, start, end, duration of speech.

    end_rule `first_inactive` ends a segment at the first inactive row after it, `last_active` at its last active row. An
    open tail is dropped unless keep_tail; segments shorter than least_s go.
    """
    found = islands(rows, active).withColumn("_next", F.lead("ts").over(by_track())).where("active")
    out = found.groupBy("track", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.max(F.struct(*ORDER, "_next")).alias("_e"))
    after = F.col("_e._next")
    end = F.coalesce(after, F.col("last")) if end_rule == "first_inactive" else F.col("last")
    out = out.withColumn("end", end).where(F.lit(keep_tail) | after.isNotNull())
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return out.withColumn("duration", seconds / 1e6).where(F.col("duration") >= least_s).select("track", "island", "start", "end", "duration")


def onsets(rows: DataFrame, active: Column) -> DataFrame:
    """track, event_id, ts of rising edges."""
    marked = rows.withColumn("active", active)
    return marked.withColumn("_before", F.coalesce(F.lag("active").over(by_track()), F.lit(False))).where(F.col("active") & ~F.col("_before")).select("track", "event_id", "ts")


def consecutive_runs(rows: DataFrame, least: int = 3) -> DataFrame:
    """track, event_id, run (rows of the same kind so far), stable (run >= least)."""
    w = by_track()
    turned = rows.withColumn("_new", F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1))
    turned = turned.withColumn("_g", F.sum("_new").over(w))
    run = F.row_number().over(Window.partitionBy("track", "_g").orderBy(*ORDER))
    return turned.select("track", "event_id", run.alias("run"), (run >= least).alias("stable"))


def movement(rows: DataFrame, size: int = 5, scale: float = 0.01) -> DataFrame:
    """track, event_id, movement: population variance of the last `size` values, scaled and cut at 1."""
    own = rows.select("track", *ORDER, "value")
    return sliding(own, ["track"], ORDER, size - 1, {"movement": lambda w: F.least(F.var_pop("value").over(w) * scale, F.lit(1.0))}).select("track", "event_id", "movement")


def carry_forward(rows: DataFrame, value: Column) -> DataFrame:
    """track, event_id, carried: the value, or the last one before it where it is null."""
    return rows.withColumn("_v", value).select("track", "event_id", F.last("_v", ignorenulls=True).over(by_track().rowsBetween(Window.unboundedPreceding, 0)).alias("carried"))


def nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (track, event_id, ts) with distance: microseconds to the nearest mark (track, ts) of the track, before or after; null without one.

    One union and two running windows, so no point meets every mark.
    """
    both = points.select("track", "event_id", "ts", F.lit(1).alias("_p")).unionByName(marks.select("track", F.lit(None).cast("long").alias("event_id"), "ts", F.lit(0).alias("_p")))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    both = both.withColumn("_t", at).withColumn("_m", F.when(F.col("_p") == 0, at))
    w = Window.partitionBy("track").orderBy("_t", "_p")
    behind = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("_b", behind).withColumn("_a", ahead).where("_p = 1").select("track", "event_id", F.least(F.col("_t") - F.col("_b"), F.col("_a") - F.col("_t")).alias("distance"))


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def inside_segments(points: DataFrame, found: DataFrame, tolerance_s: float = 0.2) -> DataFrame:
    """points (track, event_id, ts) with island: the first segment whose span, widened by the tolerance, holds the point; null without one."""
    wide = int(tolerance_s * 1e6)
    spans = found.select("track", "island", (_micros("start") - wide).alias("_lo"), (_micros("end") + wide).alias("_hi"))
    hits = points_in_intervals(points.select("track", "event_id", _micros("ts").alias("_t")), spans, ["track"], "_t", "_lo", "_hi")
    first = hits.groupBy("track", "event_id").agg(F.min("island").alias("island"))
    return points.select("track", "event_id").join(first, ["track", "event_id"], "left")


def speech_at(points: DataFrame, found: DataFrame, samples: DataFrame, window_s: float = 0.2, rms: bool = False) -> DataFrame:
    """points (track, event_id, ts) with active, energy: whether one of the segments found, widened by window_s, holds the point, and the energy around it.

    energy is the mean of |value| of the samples (track, ts, value) from window_s / 2 before to window_s / 2 after the point, or, with rms, ten times their root mean
    square, 1 at most. Without segment or samples a point is inactive, with energy 0.
    """
    held = inside_segments(points, found, window_s)
    value = F.col("value") * F.col("value") if rms else F.abs(F.col("value"))
    timed = samples.withColumn("_t", _micros("ts"))
    means = means_around(points.select("track", "event_id", _micros("ts").alias("_t")), timed, ["track"], "event_id", "_t", int(window_s * 1e6), value)
    energy = F.least(F.sqrt("mean") * 10, F.lit(1.0)) if rms else F.col("mean")
    out = held.join(means, ["track", "event_id"], "left").withColumn("active", F.col("island").isNotNull() & F.col("mean").isNotNull())
    return out.select("track", "event_id", "active", F.when(F.col("active"), energy).otherwise(0.0).alias("energy"))


def best_offset(starts: DataFrame, marks: DataFrame, steps: int = 500, step: float = 0.02, reach: float = 0.5) -> DataFrame:
    """offset_step, score of the best shift of starts (seconds t): shifts are steps of `step` from -steps / 2; a start
    scores max(0, 1 - distance / reach) by its nearest mark (seconds m); ties go to the earliest shift.

    Equal starts are taken together, and meet the marks in time bins as wide as the reach of all shifts; there each shift
    looks up the nearest mark.
    """
    n = starts.count()
    half = steps // 2
    width = half * step + reach
    marked = marks.where("m IS NOT NULL").select(F.floor(F.col("m") / width).alias("_own"), "m").distinct()
    marked = marked.select(F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)).alias("bin"), "m")
    begun = starts.where("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("n")).select(F.floor(F.col("t") / width).alias("bin"), F.col("t").cast("double").alias("t"), "n")

    def scores(a, b):
        import pandas as pd

        m, t, often, out = np.sort(b["m"].to_numpy(float)), a["t"].to_numpy(float), a["n"].to_numpy(float), []
        for k in range(-half, half + 1) if len(m) else ():
            moved = t + k * step
            at = np.searchsorted(m, moved)
            off = np.minimum(np.abs(moved - m[np.maximum(at - 1, 0)]), np.abs(moved - m[np.minimum(at, len(m) - 1)]))
            hit = off <= reach
            if hit.any():
                out.append((k, float(((1 - off[hit] / reach) * often[hit]).sum())))
        return pd.DataFrame(out, columns=["k", "s"])

    each = begun.groupBy("bin").cogroup(marked.groupBy("bin")).applyInPandas(scores, "k int, s double")
    sums = each.groupBy("k").agg((F.sum("s") / n).alias("score"))
    return sums.agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("k")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("offset_step"), F.col("b.score").alias("score"))


def frame_energy(samples: DataFrame, window: int = 20, hop: int = 10) -> DataFrame:
    """frame, n, energy (sum of squares), rms of samples (i, x) in frames of `window` samples, one each `hop`."""
    frames = F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - window) / hop) + 1).cast("long"), F.floor(F.col("i") / hop).cast("long"))
    parts = samples.select(F.explode(frames).alias("frame"), "x")
    return parts.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy")).withColumn("rms", F.sqrt(F.col("energy") / F.col("n")))


def speaker_votes(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (video, idx, start_ms, end_ms), frames (video, t_ms, frame, speaker) -> video, idx, votes, speaker, speakers.

    A span's speaker is the commonest in it (ends included); ties to the first to appear. speakers: all of them, sorted.
    """
    votes = points_in_intervals(frames.where("speaker >= 0").select("video", "t_ms", "frame", "speaker"), spans.select("video", "idx", "start_ms", "end_ms"), ["video"], "t_ms", "start_ms", "end_ms")
    counts = votes.groupBy("video", "idx", "speaker").agg(F.count("*").alias("votes"), F.min("frame").alias("first"))
    top = counts.groupBy("video", "idx").agg(F.max(F.struct("votes", (-F.col("first")).alias("f"), "speaker")).alias("b"), F.sort_array(F.collect_set("speaker")).alias("speakers"))
    return spans.select("video", "idx").join(top, ["video", "idx"], "left").select("video", "idx", F.coalesce("b.votes", F.lit(0)).alias("votes"), F.col("b.speaker").alias("speaker"), F.coalesce("speakers", F.array().cast("array<int>")).alias("speakers"))
