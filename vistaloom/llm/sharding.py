"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets of a bounded number of bytes, by a seeded hash of the record and of its place in
the input; the number of buckets follows the input. Pass 2 holds one bucket at a time, permutes it by Fisher-Yates
(drawn from a generator seeded with the bucket's number) and writes it. Buckets follow each other in one global sequence,
which is dealt to the shards in turn: sizes in rows are at most one apart, and slots have no gaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaloom.llm.util import saved

#: Text bytes of a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Buckets whose sizes are added up in one step; the sums of such groups are added up in a second.
GROUP = 1 << 12


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: place i takes the element at a random place of those not yet taken."""
    order = list(range(n))
    for i, j in enumerate(rng.integers(np.arange(n), n).tolist() if n else []):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _permuted(seed: int):
    """Of rows sorted by bucket: each bucket's rows in their new order, with their place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts)
            # Rows of a bucket come in no fixed order, so they get one first: equal input, equal shards.
            whole = whole.take(pa.array(np.lexsort((whole["place"].to_numpy(), whole["key"].to_numpy()))))
            order = fisher_yates(whole.num_rows, np.random.default_rng([seed, current]))
            for a in range(0, len(order), 2048):
                part = whole.take(pa.array(order[a : a + 2048])).combine_chunks()
                slot = pa.array(np.arange(a, a + part.num_rows, dtype=np.int64))
                yield from part.append_column("position", slot).select(["bucket", "position", "record"]).to_batches()

        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]) if len(buckets) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if buckets[a] != current and parts:
                    yield from done()
                    parts = []
                current = int(buckets[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from done()

    return run


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of docs, as `record`, with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Law `rows`: counts of shards are at most one apart; equal texts are records like others. Any column may be null;
    repeated rows are separate records, told apart by their place in the input. An empty table gives an empty result.
    The permuted records are written to the shared folder once, and everything after reads them there.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 8
    total = docs.select(size.alias("b")).agg(F.sum("b")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    keyed = docs.select(key.alias("key"), F.monotonically_increasing_id().alias("place"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"))
    keyed = keyed.select(F.pmod(F.xxhash64("key", "place"), F.lit(buckets)).cast("long").alias("bucket"), "key", "place", "record")
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("position", T.LongType()), keyed.schema["record"]])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    scattered = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    permuted = saved(scattered.mapInArrow(_permuted(seed), schema), "permuted")
    counts = saved(permuted.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", (F.col("bucket") / GROUP).cast("long")), "bucket-sizes")
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"))
    ahead = groups.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = counts.select("g", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    first = inside.join(ahead, "g").select("bucket", (F.col("before") + F.col("ahead")).alias("first"))
    at = F.col("first") + F.col("position")
    return permuted.join(first, "bucket").select("record", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet, one folder each; slot gives the order."""
    sharded.select("record.*", "shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    text = F.col("record.text").cast("string")
    return sharded.select(
        F.col("record.doc_id").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
