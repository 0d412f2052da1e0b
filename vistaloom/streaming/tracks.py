"""Streams of observations: sliding windows, sessions, and a track's smoothed state that outlives micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vistaloom.storage import place

LATE = "10 minutes"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The events at path as a stream; times are taken as UTC timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may be one file too
    return rows.select(F.col("user_id").alias("track"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("kind"))


def sliding_energy(rows: DataFrame, length: str = "2 hours", hop: str = "1 hour") -> DataFrame:
    """start, n, energy of overlapping windows of event time."""
    grouped = rows.withWatermark("ts", LATE).groupBy(F.window("ts", length, hop))
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy")).select(F.col("window.start").alias("start"), "n", "energy")


def sessions(rows: DataFrame, gap: str = "12 hours") -> DataFrame:
    """track, start, n: a track's observations with no gap of event time as long as `gap`."""
    grouped = rows.withWatermark("ts", LATE).groupBy("track", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n")).select("track", F.col("session_window.start").alias("start"), "n")


def smoothed(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """track, n, smooth: after each micro-batch, a track's count and exponential average; the state is dropped a day after its last row."""

    def step(key, parts, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, s = state.get if state.exists else (0, None)
        for value in pd.concat(parts).sort_values(["ts", "event_id"])["value"]:
            n, s = n + 1, value if s is None else alpha * value + round(1 - alpha, 12) * s
        state.update((n, s))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)
        yield pd.DataFrame({"track": [key[0]], "n": [n], "smooth": [s]})

    return rows.withWatermark("ts", LATE).groupBy("track").applyInPandasWithState(step, "track long, n long, smooth double", "n long, s double", "update", GroupStateTimeout.EventTimeTimeout)


class CarryForward(StatefulProcessor):
    """Gives each row of a track the last value that was there, in the order of event time, until the track has been silent for idle_ms.

    Rows wait until the watermark has passed them, so it doesn't matter in which micro-batch or order they come. Two timers a track at most: for the
    earliest row that waits, and for the end of the silence, at which an `expired` row is emitted and the state goes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, value double")
        self.last = handle.getValueState("last", "at long, event_id long, value double, n long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        for part in rows:
            at = part["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(a), int(e), None if v is None or v != v else float(v)) for a, e, v in zip(at, part["event_id"], part["value"])])
            self.handle.registerTimer(int(at.min()) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        at, event, value, n = self.last.get() if self.last.exists() else (None, None, None, 0)
        out = []
        ready = [tuple(r) for r in held if r[0] <= now]
        for t, e, v in ready:
            if at is not None and t - at > self.idle_ms * 1000:
                out.append((key[0], event, at, value, "expired", n))
                value, n = None, 0
            at, event, value, n = t, e, value if v is None else v, n + 1
            out.append((key[0], e, t, value, "row", n))
        rest = [tuple(r) for r in held if r[0] > now]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if at is not None and now - at > self.idle_ms * 1000:
            out.append((key[0], event, at, value, "expired", n))
            at = None
        if at is None:
            self.last.clear()
        else:
            self.last.update((at, event, value, n))
            self.handle.registerTimer(at // 1000 + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["track", "event_id", "at", "carried", "kind", "n"])

    def close(self) -> None:
        pass


def carried(rows: DataFrame, idle_ms: int, late: str = LATE) -> DataFrame:
    """track, event_id, at (microseconds), carried, kind, n of a stream (track, event_id, ts, value).

    kind `row`: a row with the last value not null of its track since its last silence of more than idle_ms, and how many rows there were since; kind
    `expired`: a silence of more than idle_ms after that row. Rows come once the watermark, `late` behind the newest row, has passed them; later ones are dropped.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = rows.select("track", "event_id", "ts", "value").withWatermark("ts", late).groupBy("track")
    return kept.transformWithStateInPandas(CarryForward(idle_ms), "track long, event_id long, at long, carried double, kind string, n long", "Append", "EventTime")


def carried_table(rows: DataFrame, idle_ms: int) -> DataFrame:
    """What carried() gives, of a table: all rows, and an `expired` row for each silence but the last."""
    own = rows.select("track", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    by = Window.partitionBy("track").orderBy("at", "event_id")
    parted = own.withColumn("_new", F.coalesce((F.col("at") - F.lag("at").over(by) > idle_ms * 1000).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(by))
    since = Window.partitionBy("track", "_run").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = parted.select("track", "event_id", "at", F.last("value", ignorenulls=True).over(since).alias("carried"), F.count("*").over(since).alias("n"), F.lead("_new").over(by).alias("_next"))
    silent = out.where("_next = 1").select("track", "event_id", "at", "carried", F.lit("expired").alias("kind"), "n")
    return out.select("track", "event_id", "at", "carried", F.lit("row").alias("kind"), "n").unionByName(silent)


def keyed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch that keys each micro-batch by its id: one that is tried again replaces what it has written, so no row is there twice."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now, and reads what it gave: in complete mode what its last micro-batch did."""
    spark = stream.sparkSession
    path = place(spark, "stream")
    query = stream.writeStream.outputMode(mode).foreachBatch(keyed_sink(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == max(p["batchId"] for p in query.recentProgress))
    return rows.drop("batch")
