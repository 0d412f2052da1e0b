"""Points in intervals and means around points against all pairs; smoothing with nulls against a loop; sliding windows over blocks."""

import random

import pytest
from pyspark.sql import functions as F

from vistaloom.operators import temporal as T
from vistaloom.operators.intervals import means_around, points_in_intervals
from vistaloom.operators.scan import affine, sliding


def test_points_in_intervals(spark):
    rng = random.Random(4)
    points = [(rng.choice([1, 2, None]), i, rng.randint(-500, 3000)) for i in range(300)]
    spans = [(rng.choice([1, 2, 3, None]), i, lo := rng.randint(-600, 3000), lo + rng.choice([-1, 0, 1, 3, 4, 15, 16, 17, 200, 5000])) for i in range(200)] + [(1, 900, None, 5), (1, 901, 5, None), (1, 902, -(1 << 40), 1 << 40)]
    want = {(p, s) for k, p, t in points for q, s, lo, hi in spans if k is not None and k == q and lo is not None and hi is not None and lo <= t <= hi}
    a, b = spark.createDataFrame(points, "k long, p long, t long"), spark.createDataFrame(spans, "k long, s long, lo long, hi long")
    got = points_in_intervals(a, b, ["k"], "t", "lo", "hi").select("p", "s").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300
    assert points_in_intervals(a, b.limit(0), ["k"], "t", "lo", "hi").count() == 0 == points_in_intervals(a.limit(0), b, ["k"], "t", "lo", "hi").count()


def test_means_around(spark):
    rng = random.Random(5)
    samples = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 400), rng.choice([None, rng.random()])) for _ in range(300)]
    points = [(rng.choice([1, 2, 3]), i, rng.randint(-50, 450)) for i in range(100)]
    got = means_around(spark.createDataFrame(points, "k long, p long, t long"), spark.createDataFrame(samples, "k long, t long, v double"), ["k"], "p", "t", 20, F.col("v") * 2).collect()
    for r in got:
        (k, _, t), = [x for x in points if x[1] == r.p]
        own = [2 * v for q, u, v in samples if q == k and v is not None and t - 10 <= u <= t + 10]
        assert r.n == len(own) and (r["mean"] is None if not own else r["mean"] == pytest.approx(sum(own) / len(own)))
    assert len(got) == 100


def test_smoothing_holds_at_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice([None, None, rng.random()])) for i in range(400)] + [(4, i, None) for i in range(400, 405)]
    want, last = {}, {}
    for k, i, v in rows:
        last[k] = last.get(k) if v is None else v if last.get(k) is None else 0.3 * v + 0.7 * last[k]
        want[i] = last[k]
    table = spark.createDataFrame(rows, "track long, event_id long, value double").withColumn("ts", F.lit(0)).repartition(5)
    got = {r.event_id: r.smooth for r in T.ema(table).collect()}
    assert got.keys() == want.keys() and all(got[i] is None if want[i] is None else got[i] == pytest.approx(want[i]) for i in want)


def test_boxes_round_halves_to_even(spark):
    rows = [(1, 0, 0.5, 1.5, 2.5, -0.5), (1, 1, None, 3.0, 4.0, 5.0), (2, 2, None, None, None, None), (2, 3, 7.0, 7.0, 7.0, 7.0)]
    table = spark.createDataFrame(rows, "track long, event_id long, x1 double, y1 double, x2 double, y2 double").withColumn("ts", F.lit(0))
    assert {r.event_id: tuple(r)[2:] for r in T.smooth_boxes(table).collect()} == {0: (0, 2, 2, 0), 1: (0, 2, 2, 0), 2: (None,) * 4, 3: (7,) * 4}


def test_sliding_windows_cross_blocks(spark):
    rows = [(i % 2, i, float(i * i % 17)) for i in range(100)]
    got = sliding(spark.createDataFrame(rows, "k long, i long, v double"), ["k"], ["i"], 3, {"s": lambda w: F.sum("v").over(w)}, block=7).collect()
    for r in got:
        assert r.s == sum(v for k, i, v in rows if k == r.k and r.i - 6 <= i <= r.i)
    assert len(got) == 100


def test_a_scan_of_several_values_across_many_partitions(spark):
    rows = spark.range(0, 3000, 1, 6).select((F.col("id") > 2500).cast("int").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        none = F.when(F.col("id") % 3 == 0, F.col("id").cast("double"))
        got = affine(rows, ["k"], ["id"], {"last": (F.when(none.isNull(), 1).otherwise(0), F.coalesce(none, F.lit(0.0)), none), "late": (F.lit(1), F.lit(1), F.when(F.col("id") >= 1700, 0.0))}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r in got:
        first = 2501 if r.k else 0
        held = r.id - r.id % 3
        assert r["last"] == (held if held >= first else None)
        assert r.late == (None if r.id < 1700 else r.id - max(1700, first))


def test_means_around_forget_what_lies_before(spark):
    """A window's mean doesn't depend on large values ahead of it."""
    samples = [(1, i, 1e6 / 3 + i) for i in range(500)] + [(1, 1000 + i, (i + 1) * 1e-9 / 7) for i in range(20)] + [(2, 5, float("inf")), (2, 100, 1.0), (2, 200, float("nan"))]
    points = [(1, 1, 1010), (1, 2, 1003), (2, 3, 5), (2, 4, 100), (2, 5, 200)]
    got = {r.p: r["mean"] for r in means_around(spark.createDataFrame(points, "k long, p long, t long"), spark.createDataFrame(samples, "k long, t long, v double"), ["k"], "p", "t", 4, F.col("v")).collect()}
    for p, t in ((1, 1010), (2, 1003)):
        own = [v for k, u, v in samples if k == 1 and t - 2 <= u <= t + 2]
        assert got[p] == pytest.approx(sum(own) / len(own), rel=1e-6, abs=0)
    assert got[3] == float("inf") and got[4] == 1.0 and got[5] != got[5]
