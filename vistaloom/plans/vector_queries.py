"""Queries over faces: similarity, clusters, centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.functions.vectors import angular_similarity, dot, verdict
from vistaloom.operators import forest, graph
from vistaloom.operators import vectors as V
from vistaloom.sources.tables import FACES, faces

#: Raw similarities of the test vectors stay below the operators' defaults.
T = 0.3


def _centers(f):
    return V.centroids(f, "cluster_id")


def _edges(s, d):
    return V.similarity_edges(faces(s, d), threshold=T)


def _nodes(s, d):
    return faces(s, d).select(F.col("face_id").alias("node"), "quality")


def _round(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def match_face_to_center(s, d):
    f = faces(s, d)
    return _round(V.match_to_center(f, _centers(f), T), "similarity")


def knn_centers(s, d):
    f = faces(s, d)
    out = V.ranked_centers(f, _centers(f)).where("rank <= 3")
    return out.select("face_id", "cluster_id", "rank", F.round(angular_similarity(F.col("similarity")), 6).alias("similarity"))


def knn_centers_by_forest(s, d):
    f = faces(s, d)
    near = forest.nearest(f.select(F.col("face_id").alias("id"), "enc"), _centers(f).select(F.col("cluster_id").alias("id"), F.col("center").alias("enc")), 3)
    return near.select(F.col("query").alias("face_id"), F.col("id").alias("cluster_id"), "rank", F.round(angular_similarity(F.col("similarity")), 6).alias("similarity"))


def nearest_faces(s, d):
    """The 10 faces nearest to each one whose id is divisible by 50, of all faces."""
    f = faces(s, d).select(F.col("face_id").alias("id"), "enc")
    return forest.nearest(f.where("id % 50 = 0"), f, 10)


def temporal_retrieval(s, d):
    f = faces(s, d)
    found = V.retrieve_with_feedback(f, V.centroids(f, "cluster_id"), threshold=0.1, video=F.expr("frame_num div 100"))
    return _round(found, "adjusted", "similarity")


def _mouthed(s, d):
    """Faces with a mouth ratio made of their ids; some have none."""
    ratio = F.when(F.col("face_id") % 11 > 0, (F.col("face_id") * 13) % 29 / 100.0)
    return faces(s, d).select(F.expr("frame_num div 50").alias("video"), "frame_num", "face_idx", "enc", ratio.alias("mouth_ratio"))


def pair_verdicts(s, d):
    pairs = V.similar_pairs(faces(s, d), T)
    return pairs.groupBy(verdict(F.col("similarity")).alias("verdict")).agg(F.count("*").alias("n"))


def cluster_sizes(s, d):
    sizes = faces(s, d).groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("dispersion"), F.max("n").alias("largest"))


QUERIES = {
    "match_face_to_center": match_face_to_center,
    "cluster_centroids": lambda s, d: _centers(faces(s, d)).select("cluster_id", "n", F.transform("center", lambda x: F.round(x, 6)).alias("center")),
    "similarity_edges": lambda s, d: _round(_edges(s, d), "weight"),
    "knn_centers_angular": knn_centers,
    "pair_verdict": pair_verdicts,
    "inter_cluster_similarity": lambda s, d: _round(V.inter_cluster_similarity(faces(s, d)), "centroid_sim", "mean_sim", "max_sim"),
    "intra_cluster_consistency": lambda s, d: _round(V.intra_cluster_consistency(faces(s, d)), "consistency"),
    "representative_face": lambda s, d: _round(V.representatives(f := faces(s, d), _centers(f)), "score"),
    "cluster_frame_ranges": lambda s, d: V.frame_ranges(faces(s, d)),
    "temporal_retrieval": temporal_retrieval,
    "knn_centers_by_forest": knn_centers_by_forest,
    "nearest_faces_by_forest": nearest_faces,
    "feedback_rerank": lambda s, d: _round(V.rerank_with_history(faces(s, d), V.centroids(faces(s, d), "cluster_id"), F.col("face_id") % 40, threshold=0.2, floor=0.1), "similarity"),
    "cluster_overlap_candidates": lambda s, d: _round(V.overlap_candidates(faces(s, d), 0.0), "similarity"),
    "small_to_large_merge": lambda s, d: _round(V.merge_small_into_large(faces(s, d), large=50, small=50, threshold=-0.2, cap=2), "similarity"),
    "track_pairs": lambda s, d: _round(V.track_pairs(faces(s, d), 0.1), "similarity"),
    "speaking_face": lambda s, d: V.speaking_face(_mouthed(s, d), similar=0.05),
    "cluster_size_dispersion": cluster_sizes,
    "label_propagation_3_rounds": lambda s, d: V.propagate_labels(faces(s, d), T, rounds=3),
    "label_propagation_converged": lambda s, d: V.propagate_labels(faces(s, d), T),
    "merge_components": lambda s, d: graph.components(_nodes(s, d), V.similar_links(faces(s, d), 0.38)),
}

_C = f"""p AS (SELECT cluster_id, g, avg(enc[g]) AS x, count(*) AS n FROM {FACES}, unnest(range(1, 65)) AS r(g) GROUP BY 1, 2),
m AS (SELECT cluster_id, max(n) AS n, list(x ORDER BY g) AS mean FROM p GROUP BY 1),
c AS (SELECT cluster_id, n, mean, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS center FROM m)"""
_PAIRS = f"(SELECT a.face_id AS src, b.face_id AS dst, a.frame_num AS fa, b.frame_num AS fb, a.cluster_id AS ca, b.cluster_id AS cb, list_dot_product(a.enc, b.enc) AS s FROM {FACES} a JOIN {FACES} b ON a.face_id < b.face_id)"
_EDGES = f"""(SELECT src, dst, w AS weight FROM (SELECT *, CASE WHEN fa > 0 AND fb > 0 AND abs(fa - fb) < 3 THEN 0.9 * s + 0.1 * (1 - abs(fa - fb) / 3.0) ELSE s END AS w FROM {_PAIRS} WHERE s >= 0.8 * {T}) WHERE w > {T})"""
_ROUND = """l{n} AS (SELECT l.node, l.quality, coalesce(b.label, l.label) AS label FROM l{p} l LEFT JOIN
 (SELECT node, label FROM (SELECT a.src AS node, l.label, row_number() OVER (PARTITION BY a.src ORDER BY round(sum(a.weight * (0.5 + 0.5 * l.quality)), 9) DESC, l.label) AS r
  FROM arcs a JOIN l{p} l ON a.dst = l.node GROUP BY a.src, l.label) WHERE r = 1) b USING (node))"""

ORACLE = {
    "match_face_to_center": f"WITH {_C}, x AS (SELECT face_id, cluster_id, list_dot_product(enc, center) AS s FROM (SELECT face_id, enc FROM {FACES}), c), b AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY s DESC, cluster_id) AS r FROM x) SELECT face_id, CASE WHEN s > {T} THEN cluster_id ELSE -1 END AS match_idx, round(CASE WHEN s > {T} THEN s ELSE 0 END, 6) AS similarity FROM b WHERE r = 1",
    "cluster_centroids": f"WITH {_C} SELECT cluster_id, n, list_transform(center, lambda x: round(x, 6)) AS center FROM c",
    "similarity_edges": f"SELECT src, dst, round(weight, 6) AS weight FROM {_EDGES}",
    "knn_centers_angular": f"WITH {_C}, x AS (SELECT face_id, cluster_id, list_dot_product(enc, center) AS s FROM (SELECT face_id, enc FROM {FACES}), c), b AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY s DESC, cluster_id) AS rank FROM x) SELECT face_id, cluster_id, rank, round(greatest(0, s), 6) AS similarity FROM b WHERE rank <= 3",
    "pair_verdict": f"SELECT CASE WHEN s > 0.5 THEN 'high' WHEN s > 0.35 THEN 'likely' ELSE 'different' END AS verdict, count(*) AS n FROM {_PAIRS} WHERE s >= {T} GROUP BY 1",
    "inter_cluster_similarity": f"WITH {_C}, x AS (SELECT least(ca, cb) AS i, greatest(ca, cb) AS j, max(s) AS m FROM {_PAIRS} WHERE ca <> cb GROUP BY 1, 2) SELECT a.cluster_id AS cluster_i, b.cluster_id AS cluster_j, round(list_dot_product(a.center, b.center), 6) AS centroid_sim, round(list_dot_product(a.mean, b.mean), 6) AS mean_sim, round(greatest(coalesce(m, 0), 0), 6) AS max_sim FROM c a JOIN c b ON a.cluster_id < b.cluster_id LEFT JOIN x ON i = a.cluster_id AND j = b.cluster_id",
    "intra_cluster_consistency": f"WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM {FACES}) WHERE r <= 20) SELECT a.cluster_id, count(DISTINCT a.face_id) AS n, round(coalesce(avg(list_dot_product(a.enc, b.enc)) FILTER (a.face_id <> b.face_id), 1), 6) AS consistency FROM f a JOIN f b USING (cluster_id) GROUP BY 1",
    "representative_face": f"WITH {_C}, x AS (SELECT cluster_id, face_id, 0.4 * list_dot_product(enc, center) + 0.6 * quality AS score FROM {FACES} JOIN c USING (cluster_id)) SELECT cluster_id, face_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, face_id) AS r FROM x) WHERE r = 1",
    "cluster_frame_ranges": f"SELECT cluster_id, count(*) AS n, min(frame_num) FILTER (frame_num > 0) AS first_frame, max(frame_num) FILTER (frame_num > 0) AS last_frame FROM {FACES} GROUP BY 1",
    "cluster_overlap_candidates": f"WITH {_C}, g AS (SELECT cluster_id, min(frame_num) FILTER (frame_num > 0) AS lo, max(frame_num) FILTER (frame_num > 0) AS hi, any_value(center) AS center FROM {FACES} JOIN c USING (cluster_id) GROUP BY 1) SELECT a.cluster_id AS cluster_i, b.cluster_id AS cluster_j, round(list_dot_product(a.center, b.center), 6) AS similarity FROM g a JOIN g b ON a.cluster_id < b.cluster_id WHERE list_dot_product(a.center, b.center) > 0 AND least(a.hi - a.lo, b.hi - b.lo) > 0 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.2 * least(a.hi - a.lo, b.hi - b.lo)",
    "small_to_large_merge": f"WITH {_C}, x AS (SELECT least(ca, cb) AS i, greatest(ca, cb) AS j, max(s) AS m FROM {_PAIRS} WHERE ca <> cb GROUP BY 1, 2), q AS (SELECT a.cluster_id AS i, b.cluster_id AS j, b.n AS nj, list_dot_product(a.center, b.center) AS cs, list_dot_product(a.mean, b.mean) AS ms, greatest(coalesce(m, 0), 0) AS mx FROM c a JOIN c b ON a.cluster_id <> b.cluster_id AND a.n >= 50 AND b.n <= 50 LEFT JOIN x ON x.i = least(a.cluster_id, b.cluster_id) AND x.j = greatest(a.cluster_id, b.cluster_id)), o AS (SELECT *, least(cs, mx, ms + 0.1) AS s FROM q WHERE cs > -0.2 AND mx > -0.15 AND ms > -0.3), b AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS r FROM o) SELECT i AS cluster_i, j AS cluster_j, round(s, 6) AS similarity, nj AS faces_added FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS k FROM b WHERE r = 1) WHERE k <= 2",
    "track_pairs": f"WITH f AS (SELECT * FROM {FACES}), p AS (SELECT frame_num, lag(frame_num) OVER (ORDER BY frame_num) AS prev FROM (SELECT DISTINCT frame_num FROM f)), x AS (SELECT a.frame_num, a.face_id, b.face_id AS prev_id, list_dot_product(a.enc, b.enc) AS s FROM f a JOIN p USING (frame_num) JOIN f b ON b.frame_num = p.prev) SELECT frame_num, face_id, prev_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY s DESC, prev_id) AS r FROM x) WHERE r = 1 AND s > 0.1",
    "cluster_size_dispersion": f"SELECT count(*) AS clusters, round(avg(n), 6) AS mean, round(stddev_pop(n) / avg(n), 6) AS dispersion, max(n) AS largest FROM (SELECT count(*) AS n FROM {FACES} GROUP BY cluster_id)",
    "label_propagation_3_rounds": f"WITH e AS (SELECT * FROM {_EDGES}), arcs AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), l0 AS (SELECT face_id AS node, quality, face_id AS label FROM {FACES}), " + ", ".join(_ROUND.format(n=n, p=n - 1) for n in (1, 2, 3)) + " SELECT node, label FROM l3",
    "merge_components": f"WITH RECURSIVE e AS (SELECT src, dst FROM {_PAIRS} WHERE s >= 0.38), a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT face_id AS node, face_id AS far FROM {FACES} UNION SELECT r.node, a.dst FROM r JOIN a ON a.src = r.far) SELECT node, min(far) AS component FROM r GROUP BY 1",
}
ORACLE["knn_centers_by_forest"] = ORACLE["knn_centers_angular"]
ORACLE["speaking_face"] = f"""WITH f AS (SELECT frame_num // 50 AS video, frame_num, face_id % 3 AS face_idx, enc, CASE WHEN face_id % 11 > 0 THEN (face_id * 13) % 29 / 100.0::DOUBLE END AS ratio FROM {FACES}),
p AS (SELECT video, frame_num, lag(frame_num) OVER (PARTITION BY video ORDER BY frame_num) AS prev FROM (SELECT DISTINCT video, frame_num FROM f)),
b AS (SELECT * FROM (SELECT a.video, a.frame_num, a.face_idx, a.ratio, q.ratio AS was, list_dot_product(a.enc, q.enc) AS s, row_number() OVER (PARTITION BY a.video, a.frame_num, a.face_idx ORDER BY list_dot_product(a.enc, q.enc) DESC, q.face_idx) AS r
  FROM f a JOIN p USING (video, frame_num) JOIN f q ON q.video = p.video AND q.frame_num = p.prev) WHERE r = 1 AND s > 0.05 AND abs(ratio - was) > 0.03),
m AS (SELECT *, row_number() OVER (PARTITION BY video, frame_num ORDER BY abs(ratio - was) DESC, face_idx) AS k FROM b)
SELECT p.video::INT AS video, p.frame_num, coalesce(m.face_idx, -1)::INT AS face_idx FROM p LEFT JOIN m ON m.video = p.video AND m.frame_num = p.frame_num AND k = 1"""
