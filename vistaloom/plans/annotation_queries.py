"""Queries over annotated subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.functions import texts as X
from vistaloom.operators import annotations as A
from vistaloom.operators import clusters as C
from vistaloom.operators import evaluation as E
from vistaloom.plans.vector_queries import _round
from vistaloom.sources.tables import FACES, OBSERVATIONS, SUBTITLES, faces, observations, subtitles, table

_BOX = ("x", "y", "w")


def _faces(s, d):
    """Observations as faces: frames of half a second of a video of forty, a match from -1 to 4, a box made of the id, and whether the face speaks."""
    e, t = F.col("event_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) / 1000) % 40000).cast("long")
    box = F.struct((e * 7 % 100).alias("x"), (e * 3 % 70).alias("y"), (e % 30 + 10).alias("w"))
    return observations(s, d).select(F.col("track").alias("video"), t.alias("t_ms"), (t / 500).cast("long").alias("frame"), e.alias("face_idx"), (e % 6 - 1).cast("int").alias("match_idx"), box.alias("box"), (e % 3 == 0).alias("speaking"))


def _flat(df):
    return df.select(*(c for c in df.columns if c != "box"), *(F.col(f"box.{c}").alias(c) for c in _BOX))


def _record(s, d):
    out = _flat(A.speaker_record(_faces(s, d), subtitles(s, d)))
    return out.withColumn("first_faces", F.array_join(F.transform("first_faces", lambda x: x.cast("string")), ","))


def _moments(s, d):
    return _faces(s, d).select("video", "frame", (F.col("frame") % 5).cast("int").alias("speaker")).distinct()


def _named(s, d):
    ids = observations(s, d).select("event_id", F.when(F.col("event_id") % 13 > 0, F.col("event_id") % 9 - 1).alias("character_id"))
    names = observations(s, d).where("event_id < 8 AND event_id % 2 = 1").select(F.col("event_id").alias("character_id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"))
    return A.named(ids, names)


def _matched(s, d):
    return observations(s, d).select(F.col("event_id").alias("face_id"), (F.col("track") % 10).alias("center_id"), (F.col("event_id") % 40 - 2).alias("frame"), F.col("value").alias("similarity"))


def _efficiency(s, d):
    years = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("episode")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    return E.sample_efficiency(years.withColumn("weighted_f1", F.col("c") / F.col("total")).withColumn("macro_f1", F.col("c") / (F.col("total") + F.col("c") + 7)))


def _members(s, d):
    """Of each video and character, whether it is one of the first faces or speakers of the video's subtitles."""
    record = A.speaker_record(_faces(s, d), subtitles(s, d))
    asked = record.select("video", "idx", "first_faces", F.array("speaker").alias("speakers"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("character_id"))
    return asked.select("video", "idx", "character_id", X.named_in(F.col("character_id"), F.col("first_faces"), F.col("speakers")).alias("known"))


QUERIES = {
    "sample_efficiency": lambda s, d: _round(_efficiency(s, d), "efficiency", "gap"),
    "confusion_log": lambda s, d: _round(E.log_counts(observations(s, d).groupBy("kind", (F.col("track") % 10).alias("guess")).agg(F.count("*").alias("n"))), "log_count"),
    "cluster_networks": lambda s, d: _round(C.networks(faces(s, d)), "similarity"),
    "subtitle_numbers": lambda s, d: observations(s, d).select("event_id", X.tolerant_int(F.concat(F.lit("\ufeff "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(" \n"))).alias("number")),
    "known_characters": _members,
    "annotation_points": lambda s, d: _round(A.annotation_points(subtitles(s, d).withColumn("text", F.concat(F.lit(" \n"), "text", F.lit("\t"))), 0.25).withColumn("text", F.md5("text")), "ts", "duration"),
    "character_names": lambda s, d: _named(s, d).select("event_id", "name"),
    "speaker_record": _record,
    "display_boxes": lambda s, d: _flat(A.display_boxes(_moments(s, d), _faces(s, d))),
    "frames_per_character": lambda s, d: _round(A.frames_per_character(_faces(s, d)), "share"),
    "status_histogram": lambda s, d: A.status_histogram(observations(s, d), F.nullif(F.col("kind"), F.lit("view"))),
    "center_timelines": lambda s, d: A.timelines(_matched(s, d)),
}

_F = f"f AS (SELECT track AS video, t AS t_ms, t // 500 AS frame, event_id AS e, (event_id % 6 - 1)::INT AS match, event_id * 7 % 100 AS x, event_id * 3 % 70 AS y, event_id % 30 + 10 AS w, event_id % 3 = 0 AS speaking FROM (SELECT *, (epoch_us(ts) // 1000) % 40000 AS t FROM {OBSERVATIONS}))"
ORACLE = {
    "annotation_points": f"SELECT video, idx, round(start_ms / 1000.0 + 0.25, 6) AS ts, round((end_ms - start_ms) / 1000.0, 6) AS duration, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM {SUBTITLES}",
    "character_names": f"SELECT event_id, CASE WHEN c = -1 THEN 'Unknown' WHEN c IN (1, 3, 5, 7) THEN 'n' || c ELSE coalesce('ID_' || c, NULL) END AS name FROM (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN event_id % 9 - 1 END AS c FROM {OBSERVATIONS})",
    "speaker_record": f"""WITH {_F}, m AS (SELECT s.video, s.idx, f.* EXCLUDE (video) FROM {SUBTITLES} s JOIN f ON f.video = s.video AND t_ms BETWEEN start_ms AND end_ms WHERE match >= 0),
v AS (SELECT video, idx, match, count(*) AS votes, min(struct_pack(frame := frame, e := e)) AS first, max(struct_pack(frame := frame, e := e, x := x, y := y, w := w)) AS b FROM m WHERE speaking GROUP BY 1, 2, 3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, idx ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1),
q AS (SELECT video, idx, min(frame) AS frame FROM m GROUP BY 1, 2), l AS (SELECT m.video, m.idx, m.frame, string_agg(match::VARCHAR, ',' ORDER BY e) AS l FROM m JOIN q USING (video, idx, frame) GROUP BY 1, 2, 3)
SELECT s.video, s.idx, t.match AS speaker, coalesce(votes, 0) AS votes, b.x AS x, b.y AS y, b.w AS w, l.frame AS first_frame, l AS first_faces FROM {SUBTITLES} s LEFT JOIN t USING (video, idx) LEFT JOIN l USING (video, idx)""",
    "display_boxes": f"WITH {_F}, m AS (SELECT DISTINCT video, frame, (frame % 5)::INT AS speaker FROM f), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, match ORDER BY e) AS r FROM f) WHERE r = 1) SELECT m.video, m.frame, m.speaker, b.x, b.y, b.w FROM m LEFT JOIN b ON b.video = m.video AND b.frame = m.frame AND b.match = m.speaker",
    "frames_per_character": f"WITH {_F}, c AS (SELECT match AS character_id, count(DISTINCT (video, frame)) AS frames FROM f GROUP BY 1) SELECT character_id, frames, CASE WHEN character_id >= 0 THEN round(frames / (SELECT sum(frames) FROM c WHERE character_id >= 0), 6) END AS share FROM c",
    "status_histogram": f"SELECT CASE WHEN kind = 'view' THEN 'none' ELSE kind END AS status, count(*) AS n FROM {OBSERVATIONS} GROUP BY 1",
    "center_timelines": f"SELECT track % 10 AS center_id, row_number() OVER (PARTITION BY track % 10 ORDER BY CASE WHEN event_id % 40 - 2 > 0 THEN event_id % 40 - 2 ELSE 99 END, value DESC, event_id) AS place, event_id % 40 - 2 AS frame, event_id AS face_id, value AS similarity FROM {OBSERVATIONS}",
}
ORACLE |= {
    "sample_efficiency": "WITH t AS (SELECT year(o_orderdate) AS episode, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1), f AS (SELECT episode, n, c / n AS w, c / (n + c + 7) AS m FROM t) SELECT episode::INT AS episode, round(w * 100 / (n / 100), 6) AS efficiency, round((w - m) * 100, 6) AS gap, (SELECT avg(w - m) * 100 > 10 FROM f) AS imbalanced FROM f",
    "confusion_log": f"SELECT kind, track % 10 AS guess, count(*) AS n, round(log10(count(*) + 1), 6) AS log_count FROM {OBSERVATIONS} GROUP BY 1, 2",
    "cluster_networks": f"WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS r FROM {FACES}) WHERE r <= 30) SELECT a.cluster_id, a.face_id AS src, b.face_id AS dst, round(list_dot_product(a.enc, b.enc), 6) AS similarity FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.face_id < b.face_id WHERE a.cluster_id IN (SELECT cluster_id FROM f GROUP BY 1 HAVING count(*) >= 3)",
    "subtitle_numbers": f"SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id END AS number FROM {OBSERVATIONS}",
}
ORACLE["known_characters"] = f"SELECT video, idx, c::INT AS character_id, coalesce(list_contains(string_split(first_faces, ','), c::VARCHAR), false) OR coalesce(speaker = c, false) AS known FROM ({ORACLE['speaker_record']}), range(0, 5) AS r(c)"
