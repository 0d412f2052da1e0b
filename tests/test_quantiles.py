"""Quantiles against numpy: hot and small groups, ties, nulls, and a sketch that brackets nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaloom.operators import quantiles as Q


@pytest.mark.parametrize("slack", [Q.SLACK, 0.0])
def test_quantiles(spark, slack, monkeypatch):
    rng = random.Random(7)
    rows = [(1, rng.gauss(0, 5)) for _ in range(20_000)] + [(2, rng.choice([1.0, 2.0, 2.0, 9.0])) for _ in range(3000)] + [(3, 4.5), (4, None), (5, 1.0), (5, 2.0), (5, None), (None, 3.0)]
    table = spark.createDataFrame(rows, "g int, v double").repartition(6)
    if not slack:
        monkeypatch.setattr(Q, "ACCURACY", 10)  # so coarse that most brackets miss; those groups are done whole
    at = [0.25, 0.5, 0.75, 1.0, 0.0]
    got = {r.g: tuple(r)[1:] for r in Q.quantiles(table, ["g"], "v", at, slack).collect()}
    want = {g: np.quantile([v for k, v in rows if k == g and v is not None], at) for g in (1, 2, 3, 5)}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert Q.quantiles(table.limit(0), ["g"], "v", [0.5]).count() == 0


def test_a_hot_group_is_ranked_by_many_tasks(spark):
    rows = spark.range(0, 100_000, 1, 8).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 100_003).alias("v"))
    assert tuple(Q.quantiles(rows, ["g"], "v", [0.5]).first()) == (1, rows.agg(F.median("v")).first()[0])
