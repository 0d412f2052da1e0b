"""The record of an annotated subtitle, and the small tables around it: points, names, boxes, timelines, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.operators.intervals import points_in_intervals
from vistaloom.operators.scan import running_sums


def annotation_points(subs: DataFrame, offset_s: float = 0.0) -> DataFrame:
    """video, idx, ts (seconds, moved by the offset), duration, text without white space around it."""
    start, end = (F.col(c) / 1000.0 for c in ("start_ms", "end_ms"))
    return subs.select("video", "idx", (start + offset_s).alias("ts"), (end - start).alias("duration"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def named(rows: DataFrame, names: DataFrame, key: str = "character_id") -> DataFrame:
    """rows with name, of names (the key, name): `Unknown` for -1, `ID_n` for those without one or with a null id."""
    found = rows.join(names.select(key, F.col("name").alias("_name")), key, "left")
    return found.withColumn("name", F.when(F.col(key) == -1, "Unknown").otherwise(F.coalesce("_name", F.concat(F.lit("ID_"), F.col(key).cast("string"))))).drop("_name")


def speaker_record(faces: DataFrame, spans: DataFrame) -> DataFrame:
    """video, idx, speaker, votes, box, first_frame, first_faces of each span (video, idx, start_ms, end_ms).

    faces: video, t_ms, frame, face_idx, match_idx, box, speaking. The speaker is the match of most speaking faces in the span (ends included; unmatched, below 0, don't vote; ties to the
    one that appears first). box is where it spoke last. first_faces are the matches of the span's first frame that has some, in the order of face_idx. A span
    without votes has no speaker and no box, one without matched faces no first frame.
    """
    met = points_in_intervals(faces.where("match_idx >= 0"), spans.select("video", "idx", "start_ms", "end_ms"), ["video"], "t_ms", "start_ms", "end_ms")
    at = F.struct("frame", "face_idx")
    each = met.where("speaking").groupBy("video", "idx", "match_idx").agg(F.count("*").alias("votes"), F.min(at).alias("first"), F.max_by("box", at).alias("box"))
    winner = each.groupBy("video", "idx").agg(F.max(F.struct("votes", (-F.col("first.frame")).alias("f"), (-F.col("first.face_idx")).alias("i"), F.col("match_idx").alias("speaker"), "box")).alias("w"))
    first = met.groupBy("video", "idx", "frame").agg(F.array_sort(F.collect_list(F.struct("face_idx", "match_idx"))).alias("own"))  # the faces of one frame
    first = first.groupBy("video", "idx").agg(F.min("frame").alias("first_frame"), F.min_by("own", "frame").alias("own"))
    out = spans.select("video", "idx").join(winner, ["video", "idx"], "left").join(first, ["video", "idx"], "left")
    return out.select("video", "idx", F.col("w.speaker").alias("speaker"), F.coalesce("w.votes", F.lit(0)).alias("votes"), F.col("w.box").alias("box"), "first_frame", F.transform("own", lambda x: x["match_idx"]).alias("first_faces"))


def display_boxes(moments: DataFrame, faces: DataFrame) -> DataFrame:
    """moments (video, frame, speaker) with box: of the first face (by face_idx) of the frame that is matched to the speaker; null without one."""
    best = faces.groupBy("video", "frame", F.col("match_idx").alias("speaker")).agg(F.min_by("box", "face_idx").alias("box"))
    return moments.join(best, ["video", "frame", "speaker"], "left")


def frames_per_character(matches: DataFrame) -> DataFrame:
    """character_id, frames, share of all matched frames: distinct frames of each match (video, frame, match_idx); -1, the unmatched, has no share."""
    each = matches.select("video", "frame", "match_idx").distinct().groupBy(F.col("match_idx").alias("character_id")).agg(F.count("*").alias("frames"))
    whole = each.where("character_id >= 0").agg(F.sum("frames").alias("_all"))
    return each.crossJoin(F.broadcast(whole)).select("character_id", "frames", F.when(F.col("character_id") >= 0, F.col("frames") / F.col("_all")).alias("share"))


def status_histogram(rows: DataFrame, status: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(status, F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def timelines(matches: DataFrame, key: str = "center_id") -> DataFrame:
    """key, place, frame, similarity: each centre's matches in the order of frames (unknown ones, not above 0, last), then similarity, the highest first.

    The place is found by a scan, so a centre that holds most matches is no one's task.
    """
    known = matches.withColumn("_known", F.when(F.col("frame") > 0, F.col("frame")).otherwise(F.lit((1 << 62))))
    return running_sums(known, [key], ["_known", F.desc("similarity"), "face_id"], {"place": F.lit(1)}).select(key, "place", "frame", "face_id", "similarity")
