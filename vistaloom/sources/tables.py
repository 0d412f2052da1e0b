"""The driver's tables as the engine's concepts: faces, observations, subtitles, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, frame_num, face_idx, quality, enc array<double>, label (and cluster_id, the same)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("face_id"), F.expr("int(vec_id div 3)").alias("frame_num"), F.expr("int(vec_id % 3)").alias("face_idx"),
        (F.expr("(vec_id * 37) % 101") / 100.0).alias("quality"), F.col("embedding").cast("array<double>").alias("enc"), "label", F.col("label").alias("cluster_id"))


FACES = "(SELECT vec_id AS face_id, (vec_id // 3)::INT AS frame_num, ((vec_id * 37) % 101) / 100.0 AS quality, embedding::DOUBLE[] AS enc, label, label AS cluster_id FROM embeddings)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, event_id, ts, value, kind: rows of a track in the order of (ts, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "event_id", "ts", "value", F.col("event_type").alias("kind"))


OBSERVATIONS = "(SELECT user_id AS track, event_id, ts, value, event_type AS kind FROM events)"


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, idx, start_ms, end_ms, text: a conversation's turns, each as long as ten milliseconds a character."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("idx"), (F.length("text") * 10).cast("long").alias("d"), "role", "text")
    end = F.sum("d").over(Window.partitionBy("video").orderBy("idx"))
    return turns.select("video", "idx", (end - F.col("d")).alias("start_ms"), end.alias("end_ms"), "role", "text")


SUBTITLES = "(SELECT conv_id AS video, turn AS idx, (sum(length(text) * 10) OVER w - length(text) * 10)::BIGINT AS start_ms, (sum(length(text) * 10) OVER w)::BIGINT AS end_ms, role, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode (year * 12 + month of orders), total, correct (orders of status F), value (mean price)."""
    orders = table(spark, sf_dir, "orders")
    episode = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("episode")
    return orders.groupBy(episode).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("correct"), F.avg("o_totalprice").alias("value"))


EPISODES = "(SELECT (year(o_orderdate) * 12 + month(o_orderdate))::INT AS episode, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS correct, avg(o_totalprice) AS value FROM orders GROUP BY 1)"
