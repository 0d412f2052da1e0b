"""Scans along range partitions against plain loops: a hot key, null keys, ties, one row, no row."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vistaloom.operators import scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(rng.choice([None, 1, 1, 1, 1, 2, 3, 4, 4]), i, rng.randrange(-(2**62), 2**62), rng.random()) for i in range(5000)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k long, o long, v long, x double").repartition(7)


def _in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_running_sums_wrap_around(table, rows):
    total, want = defaultdict(int), {}
    for k, o, v, _ in _in_order(rows):
        total[k] = (total[k] + v + 2**63) % 2**64 - 2**63
        want[o] = total[k]
    got = scan.running_sums(table, ["k"], ["o"], {"s": F.col("v")}).collect()
    assert {r.o: r.s for r in got} == want and len(got) == len(rows)


def test_affine_steps(table, rows):
    last, want = {}, {}
    for k, o, _, x in _in_order(rows):
        want[o] = last[k] = x if k not in last else 0.3 * x + 0.7 * last[k]
    first = table.withColumn("f", F.col("o") == F.min("o").over(Window.partitionBy("k")))
    step = (F.when(F.col("f"), 0.0).otherwise(0.7), F.when(F.col("f"), F.col("x")).otherwise(0.3 * F.col("x")))
    got = scan.affine(first, ["k"], ["o"], {"e": step}).collect()
    assert max(abs(want[r.o] - r.e) for r in got) < 1e-12


def test_a_hot_key_is_in_many_tasks(spark, table):
    one = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    dealt = scan.ordered(one, ["k"], ["o"]).groupBy(F.spark_partition_id()).count()
    with_aqe_off = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dealt.count() == 4 and dealt.agg(F.max("count")).first()[0] < 20_000
        got = scan.running_sums(one, ["k"], ["o"], {"s": F.lit(1)})
        assert got.where("s <> o + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_aqe_off)


def test_numbered_and_empty(table):
    assert all(r.n == r.o for r in scan.numbered(table, ["o"], "n").collect())
    nothing = table.limit(0)
    assert scan.numbered(nothing, ["o"], "n").count() == 0 == scan.running_sums(nothing, ["k"], ["o"], {"s": F.col("v")}).count()


def test_exponential_has_the_bits_of_a_loop(spark):
    """Stretches over many partitions, values that stay put (ends that differ in the last bit don't meet), nulls ahead."""
    rng = random.Random(9)
    rows = [(0 if i < 3000 else 1 if i < 3010 else 2, i, None if i < 3 or rng.random() < 0.1 else 100.1 if 500 < i < 2500 else rng.randrange(50_000) / 100) for i in range(4000)]
    last, want = {}, {}
    for k, i, v in rows:
        if v is not None:
            last[k] = v if last.get(k) is None else 0.3 * v + 0.7 * last[k]
        want[i] = last.get(k)
    table = spark.createDataFrame(rows, "k long, o long, v double").repartition(5)
    adaptive, parts = (spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = scan.exponential(table, ["k"], ["o"], {"s": F.col("v")}, 0.3).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert {r.o: r.s for r in got} == want and len(got) == len(rows)
    assert scan.exponential(table.limit(0), ["k"], ["o"], {"s": F.col("v")}, 0.3).count() == 0
