"""Subtitle tables: parsing, splitting of dialogues, annotation and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaloom.operators.intervals import points_in_intervals

from vistaloom.functions.texts import dialogue_parts, effective_length, format_time, parse_time


def parse_blocks(files: DataFrame) -> DataFrame:
    """files (video, value: a whole SRT file) -> video, idx, start_ms, end_ms, text; blocks that don't fit the form are skipped."""
    blocks = files.select("video", F.explode(F.split(F.regexp_replace("value", "^﻿", ""), r"\n\s*\n")).alias("b"))
    lines = F.split(F.trim("b"), "\n")
    times = F.split(lines[1], " --> ")
    rows = blocks.where((F.size(lines) >= 2) & F.trim(F.get(lines, F.lit(0))).rlike("^[0-9]+$") & F.contains(F.get(lines, F.lit(1)), F.lit(" --> ")))
    out = rows.select("video", F.trim(lines[0]).cast("int").alias("idx"), parse_time(F.trim(times[0])).alias("start_ms"), parse_time(F.trim(F.get(times, F.lit(1)))).alias("end_ms"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text"))
    return out.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def to_blocks(subs: DataFrame) -> DataFrame:
    """video, value: whole SRT files; what a file holds is bounded by its video."""
    block = F.concat_ws("\n", F.col("idx").cast("string"), F.concat(format_time(F.col("start_ms")), F.lit(" --> "), format_time(F.col("end_ms"))), "text", F.lit(""))
    held = subs.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("x"))
    return held.select("video", F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("value"))


def split_dialogues(subs: DataFrame, gap_ms: int = 150, short_gap_ms: int = 50) -> DataFrame:
    """video, idx (new, from 1), original_index, part, parts, start_ms, end_ms, text: a row for each line of a dialogue.

    Time is shared by effective length, with a gap between parts (a shorter one if the gaps would use it up).
    """
    parts = subs.withColumn("p", dialogue_parts(F.col("text"))).withColumn("parts", F.size("p"))
    total = F.col("end_ms") - F.col("start_ms")
    gap = F.when(F.col("parts") == 1, 0).when(total - gap_ms * (F.col("parts") - 1) > 0, gap_ms).otherwise(short_gap_ms)
    parts = parts.withColumn("gap", gap).withColumn("room", F.greatest(total - F.col("gap") * (F.col("parts") - 1), F.lit(0)))
    rows = parts.select("video", F.col("idx").alias("original_index"), "start_ms", "parts", "gap", "room", F.posexplode("p").alias("part", "text")).withColumn("len", effective_length(F.col("text")))
    own = Window.partitionBy("video", "original_index")
    before = F.coalesce(F.sum("len").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("_all", F.sum("len").over(own))
    start = F.col("start_ms") + F.floor(F.col("room") * F.col("_before") / F.col("_all")) + F.col("part") * F.col("gap")
    end = F.col("start_ms") + F.floor(F.col("room") * (F.col("_before") + F.col("len")) / F.col("_all")) + F.col("part") * F.col("gap")
    new = F.row_number().over(Window.partitionBy("video").orderBy("original_index", "part"))
    return rows.select("video", new.alias("idx"), "original_index", (F.col("part") + 1).alias("part"), "parts", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "text")


def split_report(split: DataFrame) -> DataFrame:
    """video, original_index, parts, text of the subtitles that were split, lines joined by ` / `."""
    some = split.where("parts > 1").groupBy("video", "original_index").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    return some.select("video", "original_index", F.size("x").alias("parts"), F.array_join(F.transform("x", lambda x: x["text"]), " / ").alias("text"))


def context_or_dialogue(subs: DataFrame, short_ms: int = 1000, stay_ms: int = 5000) -> DataFrame:
    """Adds status: a subtitle shorter than short_ms is a context_note, shown stay_ms from its start, the others are standard."""
    short = F.col("end_ms") - F.col("start_ms") < short_ms
    return subs.withColumn("status", F.when(short, "context_note").otherwise("standard")).withColumn("end_ms", F.when(short, F.col("start_ms") + stay_ms).otherwise(F.col("end_ms")))


def shown_at(moments: DataFrame, subs: DataFrame) -> DataFrame:
    """moments (video, t_ms) -> video, t_ms, idx, status of what is shown: all context notes, and the first standard subtitle."""
    known = context_or_dialogue(subs).select("video", "idx", "start_ms", "end_ms", "status")
    hits = points_in_intervals(moments, known, ["video"], "t_ms", "start_ms", "end_ms")
    first = F.row_number().over(Window.partitionBy("video", "t_ms", "status").orderBy("start_ms", "idx"))
    return hits.withColumn("_r", first).where((F.col("status") == "context_note") | (F.col("_r") == 1)).select("video", "t_ms", "idx", "status")
