"""Queries over frames, face quality and the upkeep of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.functions import frames as R
from vistaloom.operators import clusters as C
from vistaloom.operators import rules as U
from vistaloom.operators import vectors as V
from vistaloom.plans.vector_queries import ORACLE as _OF_VECTORS
from vistaloom.plans.vector_queries import _C, _PAIRS, _round
from vistaloom.sources.tables import FACES, OBSERVATIONS, SUBTITLES, faces, observations, subtitles


def _arithmetic(s, d):
    x, size = F.col("start_ms") % 640, F.col("idx") * 31 + 40
    return subtitles(s, d).select(
        "video", "idx", R.frame_of(F.col("start_ms"), 25.0).alias("frame"), R.ms_of(R.frame_of(F.col("start_ms"), 25.0), 24.0).alias("back"), R.shifted(F.col("start_ms"), 0.34).alias("shifted"),
        R.position_id(x, x + 1, x + size, x + 2 * size).alias("position"), R.margin(size).alias("margin"), R.margin(size, False).alias("margin_plain"), R.clamp(x - R.margin(size), 480).cast("long").alias("left"))


def _quality(s, d):
    v = F.col("value") / 300
    e, n = F.col("event_id"), lambda k: (F.col("event_id") % k) / float(k)
    return observations(s, d).select("event_id", R.face_quality(v, n(17) * 1.2, n(11), (e % 40) * 1000).alias("v1"), R.retrieval_quality(v, n(17) * 1.2, (e % 40) * 500).alias("v2"), R.colour(e % 15 - 1, F.lit(12)).alias("c"))


def _media(s, d):
    rows = observations(s, d)
    e = F.col("event_id")
    text = F.format_string("Duration: %02d:%02d:%02d.50, start: 0\n Video: h264, %dx%d, %d fps", (e / 100).cast("int"), e % 60, (e * 7) % 60, e % 50 + 100, e % 30 + 90, e % 30 + 24)
    return rows.select("event_id", R.duration_of(text).alias("seconds"), R.resolution_of(text).alias("size"), R.frame_rate_of(text).alias("fps"), R.area_of(R.resolution_of(text)).alias("area"))


def _places(s, d):
    e = F.col("event_id")
    return observations(s, d).select((F.col("track") % 20).alias("video"), (e / 20).cast("int").alias("frame"), e.alias("id"), ((e * 37) % 200).cast("double").alias("x"), ((e * 53) % 200).cast("double").alias("y"))


def _tracks(s, d):
    return C.follow(_places(s, d), 50.0, 10)


def _mouths(s, d):
    e = F.col("event_id")
    points = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct((e * (i + 3) % 50).cast("double").alias("x"), (e * (i + 7) % 60).cast("double").alias("y")))
    return observations(s, d).select("event_id", (U.mouth_aspect_ratio(points) + 1e-9).alias("mar"))


def _sizes(s, d):
    f = faces(s, d)
    a = f.groupBy("cluster_id").agg(F.count("*").alias("n")).select(F.lit("original").alias("method"), "n")
    b = f.groupBy((F.col("cluster_id") / 2).cast("int").alias("c")).agg(F.count("*").alias("n")).select(F.lit("adjusted").alias("method"), "n")
    return a.unionByName(b)


def _all_pairs(s, d):
    ids = faces(s, d).select("cluster_id").distinct()
    return ids.select(F.col("cluster_id").alias("cluster_i")).join(ids.select(F.col("cluster_id").alias("cluster_j")), F.col("cluster_i") < F.col("cluster_j"))


QUERIES = {
    "frame_arithmetic": _arithmetic,
    "face_quality_scores": lambda s, d: _round(_quality(s, d).withColumns({"v1": F.col("v1") + 1e-9, "v2": F.col("v2") + 1e-9}), "v1", "v2").drop("c"),
    "color_by_id": lambda s, d: _quality(s, d).select("event_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("bgr")),
    "media_info_parse": _media,
    "previous_track": _tracks,
    "cluster_method_choice": lambda s, d: C.choose_method(_sizes(s, d)),
    "merge_safety": lambda s, d: _round(C.merge_safety(faces(s, d), _all_pairs(s, d), threshold=-0.01), "c_small", "c_union", "cross"),
    "safe_small_to_large_merge": lambda s, d: _round(C.merge_small_into_large_safely(faces(s, d), large=50, small=70, threshold=-0.02, cap=2), "similarity"),
    "overlap_merge": lambda s, d: C.merge_overlapping(faces(s, d), 0.01),
    "mouth_aspect_ratio": lambda s, d: _round(_mouths(s, d), "mar"),
    "intelligent_merge": lambda s, d: _round(C.merge_scores(faces(s, d), 60, 0.0), "score"),
    "first_track": lambda s, d: C.follow_first(_places(s, d)),
    "intelligent_merge_safe": lambda s, d: _round(C.merge_by_score(faces(s, d), 70, 0.0, drop=0.002), "score"),
    "center_pages": lambda s, d: C.pages(V.frame_ranges(faces(s, d)), "cluster_id", 4).select("cluster_id", "n", "page"),
    "matches_per_center": lambda s, d: _round(C.center_summary(observations(s, d).select(F.col("track").alias("center_id"), (F.col("value") / 100).alias("similarity")), 60), "mean"),
    "seeded_sample": lambda s, d: C.seeded_sample(faces(s, d), "cluster_id", "face_id", 20).groupBy("cluster_id").agg(F.count("*").alias("n")),
}

_HUE = "(i / 12.0::DOUBLE * 6)"


def _hsv(kind: str) -> str:
    p, q, t, v = "0.18", f"(0.9 * (1 - 0.8 * ({_HUE} - floor({_HUE}))))", f"(0.9 * (1 - 0.8 * (1 - ({_HUE} - floor({_HUE})))))", "0.9"
    rgb = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    part = {"r": 0, "g": 1, "b": 2}[kind]
    return "CASE " + " ".join(f"WHEN floor({_HUE}) = {k} THEN trunc({x[part]}::DOUBLE * 255)::INT" for k, x in enumerate(rgb)) + " END"


ORACLE = {
    "frame_arithmetic": f"WITH a AS (SELECT video, idx, start_ms, start_ms % 640 AS x, idx * 31 + 40 AS size, round_even(start_ms / 1000 * 25, 0)::BIGINT AS frame FROM {SUBTITLES}) SELECT video, idx, frame, trunc(frame / 24.0::DOUBLE * 1000)::BIGINT AS back, start_ms + 340 AS shifted, ((x + x + size) // 2) || '_' || ((x + 1 + x + 2 * size) // 2) AS position, trunc(44 * size / 160)::INT AS margin, trunc(size * 0.2)::INT AS margin_plain, greatest(0, least(x - trunc(44 * size / 160), 480))::BIGINT AS left FROM a",
    "face_quality_scores": f"SELECT event_id, round(0.3 * least(value / 300, 1) + 0.2 * least((event_id % 17) / 17 * 1.2, 1) + 0.4 * (event_id % 11) / 11 + 0.1 * least((event_id % 40) * 1000 / 25600, 1) + 1e-9, 6) AS v1, round(least(1, 1.2 * (0.35 * least(value / 300, 1) + 0.35 * least((event_id % 17) / 17 * 1.2, 1) + 0.3 * least((event_id % 40) * 500 / 12544, 1))) + 1e-9, 6) AS v2 FROM {OBSERVATIONS}",
    "color_by_id": f"SELECT event_id, CASE WHEN i BETWEEN 0 AND 11 THEN ({_hsv('b')}) || ',' || ({_hsv('g')}) || ',' || ({_hsv('r')}) ELSE '128,128,128' END AS bgr FROM (SELECT event_id, event_id % 15 - 1 AS i FROM events)",
    "media_info_parse": "SELECT event_id, (event_id // 100) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + 0.5::DOUBLE AS seconds, (event_id % 50 + 100) || 'x' || (event_id % 30 + 90) AS size, (event_id % 30 + 24)::DOUBLE AS fps, (event_id % 50 + 100) * (event_id % 30 + 90) AS area FROM events",
    "cluster_method_choice": "SELECT CASE WHEN b.k <= 0.7 * a.k OR (b.k <= a.k AND b.cv < 0.8 * a.cv) THEN 'adjusted' ELSE 'original' END AS chosen FROM (SELECT count(*) AS k, stddev_pop(n) / avg(n) AS cv FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) a, (SELECT count(*) AS k, stddev_pop(n) / avg(n) AS cv FROM (SELECT count(*) AS n FROM embeddings GROUP BY label // 2)) b",
    "merge_safety": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM {FACES}), n AS (SELECT cluster_id, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT a.cluster_id, avg(list_dot_product(a.enc, b.enc)) AS c, avg(list_dot_product(a.enc, b.enc)) FILTER (b.r <= 30) AS h FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.r < b.r GROUP BY 1),
p AS (SELECT a.cluster_id AS i, b.cluster_id AS j, a.n AS ni, b.n AS nj FROM n a JOIN n b ON a.cluster_id < b.cluster_id),
u AS (SELECT i, j, 1 AS x, r, enc FROM p JOIN f ON f.cluster_id = i AND r <= 20 UNION ALL SELECT i, j, 2, r, enc FROM p JOIN f ON f.cluster_id = j),
k AS (SELECT a.i, a.j, avg(list_dot_product(a.enc, b.enc)) AS c FROM u a JOIN u b ON a.i = b.i AND a.j = b.j AND (a.x < b.x OR (a.x = b.x AND a.r < b.r)) GROUP BY 1, 2),
x AS (SELECT i, j, avg(list_dot_product(a.enc, b.enc)) AS x FROM p JOIN f a ON a.cluster_id = i JOIN f b ON b.cluster_id = j WHERE ni > 1 AND nj > 1 GROUP BY 1, 2)
SELECT p.i AS cluster_i, p.j AS cluster_j, round(coalesce(b.c, 1), 6) AS c_small, round(k.c, 6) AS c_union, round(x, 6) AS "cross", NOT ((nj < 0.03 * ni AND nj < 3) OR coalesce(b.c, 1) < -0.01 OR coalesce(a.h, 1) - k.c > 0.08 OR coalesce(x < -0.06, false)) AS safe
FROM p JOIN k USING (i, j) LEFT JOIN x USING (i, j) LEFT JOIN s a ON a.cluster_id = p.i LEFT JOIN s b ON b.cluster_id = p.j""",
    "overlap_merge": f"""WITH RECURSIVE o AS (SELECT * FROM ({_OF_VECTORS["cluster_overlap_candidates"]}) WHERE similarity > 0.01), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM {FACES}) WHERE r <= 5),
e AS (SELECT cluster_i, cluster_j FROM o JOIN f a ON a.cluster_id = cluster_i JOIN f b ON b.cluster_id = cluster_j GROUP BY 1, 2 HAVING avg(list_dot_product(a.enc, b.enc)) > 0.01),
a AS (SELECT cluster_i AS src, cluster_j AS dst FROM e UNION ALL SELECT cluster_j, cluster_i FROM e), r AS (SELECT cluster_id AS node, cluster_id AS far FROM {FACES} UNION SELECT r.node, a.dst FROM r JOIN a ON a.src = r.far)
SELECT node AS cluster_id, min(far) AS merged_id FROM r GROUP BY 1""",
    "safe_small_to_large_merge": f"""WITH {_C}, x AS (SELECT least(ca, cb) AS i, greatest(ca, cb) AS j, max(s) AS m FROM {_PAIRS} WHERE ca <> cb GROUP BY 1, 2),
q AS (SELECT a.cluster_id AS i, b.cluster_id AS j, a.n AS ni, b.n AS nj, list_dot_product(a.center, b.center) AS cs, list_dot_product(a.mean, b.mean) AS ms, greatest(coalesce(m, 0), 0) AS mx FROM c a JOIN c b ON a.cluster_id <> b.cluster_id AND a.n >= 50 AND b.n <= 70 LEFT JOIN x ON x.i = least(a.cluster_id, b.cluster_id) AND x.j = greatest(a.cluster_id, b.cluster_id)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS r FROM (SELECT *, least(cs, mx, ms + 0.1) AS s FROM q WHERE cs > -0.02 AND mx > 0.03 AND ms > -0.12)) WHERE r = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM {FACES}),
own AS (SELECT a.cluster_id, avg(list_dot_product(a.enc, b.enc)) AS c, avg(list_dot_product(a.enc, b.enc)) FILTER (b.r <= 30) AS h FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.r < b.r GROUP BY 1),
u AS (SELECT i, j, 1 AS x, r, enc FROM (SELECT i, j FROM o) JOIN f ON f.cluster_id = i AND r <= 20 UNION ALL SELECT i, j, 2, r, enc FROM (SELECT i, j FROM o) JOIN f ON f.cluster_id = j),
k AS (SELECT a.i, a.j, avg(list_dot_product(a.enc, b.enc)) AS c FROM u a JOIN u b ON a.i = b.i AND a.j = b.j AND (a.x < b.x OR (a.x = b.x AND a.r < b.r)) GROUP BY 1, 2),
y AS (SELECT i, j, avg(list_dot_product(a.enc, b.enc)) AS y FROM o JOIN f a ON a.cluster_id = i JOIN f b ON b.cluster_id = j WHERE ni > 1 AND nj > 1 GROUP BY 1, 2),
safe AS (SELECT o.* FROM o JOIN k USING (i, j) LEFT JOIN y USING (i, j) LEFT JOIN own a ON a.cluster_id = o.i LEFT JOIN own b ON b.cluster_id = o.j WHERE NOT ((nj < 0.03 * ni AND nj < 3) OR coalesce(b.c, 1) < -0.02 OR coalesce(a.h, 1) - k.c > 0.08 OR coalesce(y < -0.07, false)))
SELECT i AS cluster_i, j AS cluster_j, round(s, 6) AS similarity, nj AS faces_added FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS t FROM safe) WHERE t <= 2""",
    "mouth_aspect_ratio": "SELECT event_id, round(CASE WHEN w < 1 THEN 0 ELSE (abs(e * 16 % 60 - e * 10 % 60) + abs(e * 17 % 60 - e * 9 % 60) + abs(e * 15 % 60 - e * 11 % 60)) / 3.0::DOUBLE / w END + 1e-9, 6) AS mar FROM (SELECT event_id, event_id AS e, abs(event_id * 9 % 50 - event_id * 3 % 50) AS w FROM events)",
    "intelligent_merge": f"WITH {_C}, x AS (SELECT least(ca, cb) AS i, greatest(ca, cb) AS j, max(s) AS m FROM {_PAIRS} WHERE ca <> cb GROUP BY 1, 2), q AS (SELECT a.cluster_id AS i, b.cluster_id AS j, 0.4 * list_dot_product(a.center, b.center) + 0.3 * greatest(coalesce(m, 0), 0) + 0.3 * list_dot_product(a.mean, b.mean) AS s FROM c a JOIN c b ON a.cluster_id <> b.cluster_id AND b.n < 60 LEFT JOIN x ON x.i = least(a.cluster_id, b.cluster_id) AND x.j = greatest(a.cluster_id, b.cluster_id)) SELECT i AS cluster_i, j AS cluster_j, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS r FROM q WHERE s > 0) WHERE r = 1",
    "center_pages": "SELECT label AS cluster_id, count(*) AS n, ((row_number() OVER (ORDER BY label) - 1) // 4)::INT AS page FROM embeddings GROUP BY label",
    "matches_per_center": f"SELECT track AS center_id, count(*) AS n, round(avg(value / 100), 6) AS mean FROM {OBSERVATIONS} GROUP BY 1 HAVING count(*) >= 60",
    "seeded_sample": "SELECT label AS cluster_id, least(count(*), 20) AS n FROM embeddings GROUP BY 1",
}
ORACLE["intelligent_merge_safe"] = ORACLE["intelligent_merge"].replace("b.n < 60", "b.n < 70").replace("SELECT i AS cluster_i, j AS cluster_j, round(s, 6) AS score FROM (", ", o AS (SELECT i, j, s FROM (") + f"""),
f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM {FACES}),
own AS (SELECT a.cluster_id AS k, avg(list_dot_product(a.enc, b.enc)) AS c FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.face_id < b.face_id GROUP BY 1),
head AS (SELECT a.cluster_id AS k, avg(list_dot_product(a.enc, b.enc)) AS c FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.face_id < b.face_id AND a.r <= 50 AND b.r <= 50 GROUP BY 1),
u AS (SELECT o.i, o.j, face_id, enc FROM o JOIN f ON cluster_id IN (o.i, o.j) AND r <= 25),
un AS (SELECT a.i, a.j, avg(list_dot_product(a.enc, b.enc)) AS c FROM u a JOIN u b ON a.i = b.i AND a.j = b.j AND a.face_id < b.face_id GROUP BY 1, 2),
n AS (SELECT cluster_id AS k, count(*) AS n FROM f GROUP BY 1)
SELECT o.i AS cluster_i, o.j AS cluster_j, round(s, 6) AS score, nj.n AS faces_added FROM o JOIN un USING (i, j) JOIN n ni ON ni.k = o.i JOIN n nj ON nj.k = o.j LEFT JOIN own ON own.k = o.j LEFT JOIN head ON head.k = o.i
WHERE NOT (nj.n < 0.02 * ni.n AND nj.n < 5) AND coalesce(own.c, 1) >= -0.1 AND coalesce(head.c, 1) - un.c <= 0.002"""
