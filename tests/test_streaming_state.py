"""Carrying values along a stream: several micro-batches, rows out of order, a late row, expiries; and a sink that is tried again."""

from pyspark.sql import functions as F

from vistaloom.streaming import tracks as S

HOUR, START = 3_600_000_000, 1000


def _written(spark, tmp_path, parts):
    for i, part in enumerate(parts):
        rows = spark.createDataFrame([(t, e, (START + h) * HOUR, v) for t, e, h, v in part], "track long, event_id long, at long, value double")
        rows.select("track", "event_id", F.timestamp_micros("at").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.read.parquet(*[f"{tmp_path}/in/{i}" for i in range(len(parts))])


def test_carried_equals_the_table(spark, tmp_path):
    parts = [
        [(1, 1, 0, 5.0), (1, 3, 2, None), (2, 10, 1, None)],
        [(1, 2, 1, 6.0), (2, 11, 3, 7.0), (1, 4, 4, None)],  # event 2 is out of order, but not late
        [(1, 5, 40, None), (2, 12, 41, None)],  # both tracks were silent
        [(3, 20, 42, 1.5)],
        [(1, 99, 5, 1.0), (4, 30, 100, 2.5)],  # event 99 is late: the watermark is at 39 hours; event 30 moves it, so that the silences end
    ]
    table = _written(spark, tmp_path, parts)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    out = S.run_available(S.carried(stream, 10 * 3_600_000, late="2 hours"), "append")
    want = S.carried_table(table.where("event_id <> 99"), 10 * 3_600_000).where("event_id <> 30").collect()
    last = [(1, 5, (START + 40) * HOUR, None, "expired", 1), (2, 12, (START + 41) * HOUR, None, "expired", 1), (3, 20, (START + 42) * HOUR, 1.5, "expired", 1)]
    order = lambda r: (r[0], r[2], r[1], r[4])
    assert sorted([tuple(r) for r in out.select("track", "event_id", "at", "carried", "kind", "n").collect()], key=order) == sorted([tuple(r[c] for c in ("track", "event_id", "at", "carried", "kind", "n")) for r in want] + last, key=order)


def test_a_batch_tried_again_leaves_no_double_row(spark, tmp_path):
    keep, rows = S.keyed_sink(f"{tmp_path}/out"), spark.range(10)
    for number in (0, 1, 1, 0):
        keep(rows.withColumn("x", F.lit(number)), number)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
