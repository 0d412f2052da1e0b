"""The forest against brute force: recall, exactness in one leaf, copies, ties, few and no items, a fit on a sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaloom.operators import forest
from vistaloom.sources.tables import faces


def exact(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    return {q: ids[np.lexsort((ids, -(v @ np.array(e)).round(12)))[:k]].tolist() for q, e in queries}


@pytest.mark.parametrize(("fit", "looked_at"), [(forest.FIT, forest.LOOKED_AT), (200, 8000)])
def test_recall_on_the_given_faces(spark, fit, looked_at):
    f = faces(spark, "/root/testdata/sf0.1").select(F.col("face_id").alias("id"), "enc")
    got = forest.nearest(f.where("id % 50 = 0"), f, 10, looked_at, fit=fit).collect()
    rows = [(r.id, r.enc) for r in f.collect()]
    want = exact(rows, [r for r in rows if r[0] % 50 == 0], 10)
    hit = sum(r.id in want[r.query] for r in got)
    assert len(got) == 10 * len(want) and hit >= 0.9 * len(got)
    assert all(r.rank == 1 for r in got if r.query == r.id)


def test_copies_ties_and_few_items(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(20)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    table = spark.createDataFrame(rows, "id long, enc array<double>")
    got = forest.nearest(table, table, 4, looked_at=10_000).collect()
    want = exact(rows, rows, 4)
    assert {q: [r.id for r in sorted(got, key=lambda r: r.rank) if r.query == q] for q in want} == want
    few = table.where("id < 5")
    assert {(r.query, r.id) for r in forest.nearest(table, few, 9).collect()} == {(q, i) for q, _ in rows for i in range(5)}
    assert forest.nearest(table, table.limit(0), 3).count() == 0 == forest.nearest(table.limit(0), table, 3).count()


def test_leaves_are_bounded_and_whole(spark):
    f = faces(spark, "/root/testdata/sf0.01").select(F.col("face_id").alias("id"), "enc")
    grown = forest.grow(f, trees=3)
    v = np.array([r.enc for r in f.collect()])
    for t in range(3):
        sizes = np.bincount(grown.leaves(v, t))
        assert sizes.max() <= forest.LEAF and sizes.sum() == len(v) and (grown.left[t] == -1).sum() >= len(v) / forest.LEAF
        opened = [x for x in forest_opened(grown, v[0]) if x[0] == t]
        assert (t, int(grown.leaves(v[:1], t)[0])) in opened


def forest_opened(grown, vector):
    grown.sizes = [np.ones(len(x), int) for x in grown.left]
    return grown.opened(vector, 20)
