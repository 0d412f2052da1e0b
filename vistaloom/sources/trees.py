"""Reports in trees of folders: a method, in it a folder for each episode, in it the report. And files paired by their stem."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaloom.functions.texts import episode_number

REPORT = "metrics_summary.txt"
#: Kinds of files that make a pair; of the second kind the first that is there is taken.
VIDEOS, AUDIOS = ("mp4", "avi", "mkv", "mov"), ("mp3", "wav", "aac", "flac", "ogg", "m4a")
_FIELDS = "method string, folder string, episode int, report string"


def _found(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """The files that are there, by the file system's own listing: folders that no pattern names are neither listed nor opened."""
    out: list[str] = []
    for pattern in patterns:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        out += [str(x.getPath()) for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]
    return sorted(set(out))


def _reports(spark: SparkSession, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], _FIELDS)
    part = lambda back: F.element_at(F.split(F.col("_metadata.file_path"), "/"), back)
    rows = spark.read.text(files, wholetext=True).select(F.url_decode(F.regexp_replace(part(-3), r"\+", "%2B")).alias("method"), part(-2).alias("folder"), F.col("value").alias("report"))
    return rows.select("method", "folder", episode_number(F.col("folder")).cast("int").alias("episode"), "report")


def read_metrics_tree(spark: SparkSession, base: str, methods: Iterable[str], folders: Iterable[str], file: str = REPORT) -> DataFrame:
    """method, folder, episode, report of the reports that are there, of the methods and episode folders asked for. Missing ones are left out."""
    return _reports(spark, _found(spark, [f"{base}/{m}/{f}/{file}" for m in methods for f in folders]))


def read_episode_reports(spark: SparkSession, base: str, file: str = REPORT) -> DataFrame:
    """folder, episode, report of all folders of base whose name holds `ep` and a number of an episode above 0."""
    rows = _reports(spark, _found(spark, [f"{base}/*[eE][pP]*/{file}"]))
    return rows.where("episode > 0").select("folder", "episode", "report")


def _number(text: Column, label: str) -> Column:
    found = F.regexp_extract(text, label + r":\s*([\d.]+)", 1)
    return F.when(found != "", found.try_cast("double"))


def report_fields(report: Column) -> dict[str, Column]:
    """The numbers of a report by name, null where they are missing. Averages are looked for in their own section only: the macro one
    ends where the weighted one begins, and isn't there without it; the weighted one ends at the best class or with the text."""
    weighted = F.regexp_extract(report, r"(?s)Weighted Average:(.*?)(?=Best performing|\z)", 1)
    macro = F.regexp_extract(report, r"(?s)Macro Average:(.*?)Weighted Average:", 1)
    out = {"total_samples": F.regexp_extract(report, r"Total samples:\s*(\d+)", 1).try_cast("long"), "correct_predictions": F.regexp_extract(report, r"Correct predictions:\s*(\d+)", 1).try_cast("long"), "overall_accuracy": _number(report, "Overall Accuracy")}
    for name, section in (("weighted", weighted), ("macro", macro)):
        out |= {f"{name}_{field}": _number(section, label) for field, label in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1-Score"))}
    return out | {"best_class": _number(report, "Best performing class"), "worst_class": _number(report, "Worst performing class")}


def list_files(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    """path of the files of a folder of these kinds; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(folder).select("path")


def pair_by_stem(videos: DataFrame, audios: DataFrame, kinds: tuple[str, ...] = AUDIOS) -> DataFrame:
    """video, audio: each video's path with the audio path of the same stem, of the first of `kinds` that is there (ties: smallest path). Videos without one are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    stem, kind = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)
    rank = F.array_position(F.array(*map(F.lit, kinds)), kind)
    heard = audios.select(stem.alias("stem"), F.col("path").alias("audio"), rank.alias("rank")).where("rank > 0").groupBy("stem").agg(F.min(F.struct("rank", "audio")).alias("b"))
    return videos.select(stem.alias("stem"), F.col("path").alias("video")).join(heard, "stem").select("video", F.col("b.audio").alias("audio"))
