"""Pairs of several blocks, and components, against brute force."""

import random

import numpy as np
import pytest

from vistaloom.operators import graph
from vistaloom.operators import vectors as V


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(3)
    return [(i, int(i % 7), int(rng.integers(0, 6)), rng.normal(size=5).tolist()) for i in range(120)]


def _table(spark, members):
    return spark.createDataFrame(members, "face_id long, frame_num int, cluster_id int, enc array<double>")


def test_pairs_and_maxima_over_blocks(spark, members, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    v = np.array([m[3] for m in members])
    s = v @ v.T
    got = V.similar_pairs(_table(spark, members), 1.5).collect()
    want = {(i, j): s[i, j] for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 1.5}
    assert {(r.src, r.dst): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    assert all((r.src_frame, r.dst_frame) == (r.src % 7, r.dst % 7) for r in got)
    most = {}
    for i in range(120):
        for j in range(120):
            a, b = members[i][2], members[j][2]
            if a < b:
                most[a, b] = max(most.get((a, b), -9), s[i, j])
    assert {(r.cluster_i, r.cluster_j): r.max_sim for r in V.cluster_maxima(_table(spark, members)).collect()} == pytest.approx(most)
    assert V.cluster_maxima(_table(spark, members).limit(0)).count() == 0 == V.similar_pairs(_table(spark, members).limit(0), 0.0).count()


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1, 1.0) for i in range(60)] + [(200, j, 1.0) for j in range(201, 260)] + [(300, 300, 1.0)] + [(rng.randrange(400, 440), rng.randrange(400, 440), 1.0) for _ in range(30)]
    parent = {n: n for n in range(450)}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b, _ in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = spark.createDataFrame([(n,) for n in parent], "node long")
    got = graph.components(nodes, spark.createDataFrame(pairs, "src long, dst long, weight double")).collect()
    assert {r.node: r.component for r in got} == {n: root(n) for n in parent} and len(got) == len(parent)


def _fixpoint(labels, arcs, quality):
    """Nodes whose label isn't the one that their neighbours vote for."""
    votes = {}
    for (a, b), w in arcs.items():
        for i, j in ((a, b), (b, a)):
            votes.setdefault(i, {}).setdefault(labels[j], []).append(w * (0.5 + 0.5 * quality[j]))
    return [i for i, v in votes.items() if min(v, key=lambda label: (-round(sum(v[label]), 9), label)) != labels[i]]


def test_labels_settle_in_a_few_rounds_of_a_dense_graph(spark):
    """Forty nodes that all know each other took forty steps a round, one for each colour."""
    rng = random.Random(8)
    quality = {i: rng.random() for i in range(80)}
    arcs = {(i, j): 0.3 + rng.random() for i in range(80) for j in range(i + 1, 80) if j < 40 or (i >= 40 and rng.random() < 0.1) or rng.random() < 0.01}
    nodes = spark.createDataFrame(list(quality.items()), "node long, quality double")
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in arcs.items()], "src long, dst long, weight double")
    both = graph.cut(graph._both_ways(edges))
    asked = []

    def vote(labels):
        asked.append(1)
        return graph._vote(labels, both)

    got = {r.node: r.label for r in graph.settled(nodes, vote, lambda movers: graph._hindered(movers, both), 100).collect()}
    assert not _fixpoint(got, arcs, quality) and got.keys() == quality.keys() and len(asked) < 30


@pytest.mark.parametrize("tile", [1 << 21, 300])
def test_labels_by_panels(spark, tile, monkeypatch):
    monkeypatch.setattr(V, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 40), i % 11 / 10, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(150, 6)))]
    faces = spark.createDataFrame(rows, "face_id long, frame_num int, quality double, enc array<double>")
    edges = V.similarity_edges(faces, 0.4)
    want = {r.node: r.label for r in graph.propagate_rounds(faces.selectExpr("face_id AS node", "quality"), edges, 3).collect()}
    assert {r.node: r.label for r in V.propagate_labels(faces, 0.4, rounds=3).collect()} == want and len(set(want.values())) > 3
    ends = {r.node: r.label for r in V.propagate_labels(faces, 0.4).collect()}
    assert not _fixpoint(ends, {(r.src, r.dst): r.weight for r in edges.collect()}, {r[0]: r[2] for r in rows}) and ends.keys() == want.keys()
    assert V.propagate_labels(faces.limit(0), 0.4).count() == 0


def test_blocks_send_a_vector_so_often_at_most(spark, members, monkeypatch):
    """Pairs of many small blocks sent every vector as often as there were blocks; null frames count as unknown; links hold the same components together."""
    monkeypatch.setattr(V, "BLOCK", 4)
    monkeypatch.setattr(V, "BLOCKS", 5)
    monkeypatch.setattr(V, "TILE", 100)
    faces = _table(spark, [(i, None if i == 9 else f, c, e) for i, f, c, e in members])
    assert V._blocks(faces, "face_id").count() == 5 * len(members)
    v = np.array([m[3] for m in members])
    s = v @ v.T
    pairs = V.similar_pairs(faces, 4.0)
    assert {(r.src, r.dst) for r in pairs.collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 4.0}
    nodes = faces.selectExpr("face_id AS node")
    want = {tuple(r) for r in graph.components(nodes, pairs).collect()}
    assert {tuple(r) for r in graph.components(nodes, V.similar_links(faces, 4.0)).collect()} == want and len({c for _, c in want}) > 2
