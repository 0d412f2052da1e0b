"""Readers and writers of the file forms in use: subtitles, annotations, matrices, reports, cluster folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaloom.functions.texts import episode_number
from vistaloom.operators.subtitles import parse_blocks, to_blocks

ANNOTATION = "map<string, struct<subtitle_id:int, position:string, timestamp:double, text:string, speaker_id:int, speaker_ids:array<int>, status:string>>"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """video (the file's path), idx, start_ms, end_ms, text of all SRT files at path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("video"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    return parse_blocks(files)


def write_srt(subs: DataFrame, path: str) -> None:
    """One text a video, in a folder for each."""
    to_blocks(subs).write.partitionBy("video").text(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, key and the fields of each annotation of JSON files that hold one object of records."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", ANNOTATION)).alias("key", "a"))
    return whole.select("file", "key", "a.*")


def write_annotations(rows: DataFrame, path: str) -> None:
    """rows (video, key, fields..) as one JSON object a video. -1 stands for an unknown speaker."""
    fields = [c for c in rows.columns if c not in ("video", "key")]
    entry = F.struct("key", F.struct(*(F.coalesce(F.col(c), F.lit(-1)).alias(c) if c == "speaker_id" else F.col(c) for c in fields)).alias("value"))
    held = rows.groupBy("video").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    held.write.partitionBy("video").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A confusion matrix in CSV: the first column is the true label."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """name, episode, report of text reports, the episode taken from the folder's name."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return whole.select(name.alias("name"), episode_number(name).alias("episode"), F.col("value").alias("report"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_clusters(members: DataFrame, path: str) -> None:
    """A folder for each cluster."""
    members.write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def write_gated(gated: DataFrame, path: str) -> None:
    """Rows that passed and rows that didn't, in two folders."""
    gated.write.mode("overwrite").partitionBy("is_valid").parquet(path)


def every_nth_frame(frames: DataFrame, n: int) -> DataFrame:
    """Frames whose number is divisible by n, with their zero-padded file names."""
    return frames.where(F.col("frame_idx") % n == 0).withColumn("path", F.format_string("frame_%06d.jpg", "frame_idx"))


#: How the names of faces begin, by where they come from; all are matched from the start of the name, and may go on after it.
FACE_NAMES = {"detection": r"^frame_(\d+)_face_(\d+)\.jpg", "retrieval": r"^.*frame_(\d+)_face_(\d+)\.jpg", "legacy": r"^retrieval_frame_(\d+)_mainface_(\d+)\.jpg"}


def face_of(path, form: str = "detection") -> list:
    """frame_num and face_idx from a face's file name of one of FACE_NAMES; -1 where it has another form."""
    name = F.element_at(F.split(path, "/"), -1)
    found = lambda i: F.regexp_extract(name, FACE_NAMES[form], i)
    return [F.when(found(1) != "", found(i).try_cast("int")).otherwise(-1).alias(c) for i, c in ((1, "frame_num"), (2, "face_idx"))]
