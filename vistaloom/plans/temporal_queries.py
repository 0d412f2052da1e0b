"""Queries over tracks of observations, segments and subtitles in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.operators import temporal as T
from vistaloom.sources.tables import FACES, OBSERVATIONS, SUBTITLES, faces, observations, subtitles
from vistaloom.plans.vector_queries import _round

#: An observation is active above this value.
LOUD = 60.0
#: Added before rounding, so that sums in another order don't part at a half.
NUDGE = 1e-9


def _active():
    return F.col("value") > LOUD


def _matched(s, d):
    rank = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("kind")).cast("int") - 2
    return observations(s, d).withColumn("match", rank).withColumn("similarity", F.least(F.col("value") / 100, F.lit(1.0)))


def _segments(s, d, **rule):
    found = T.segments(observations(s, d), _active(), **rule)
    return _round(found, "duration", places=3)


def _scaled(s, d):
    return observations(s, d).withColumn("value", F.least(F.col("value") / 100, F.lit(1.0)))


def _speakers(s, d):
    rows = observations(s, d)
    return rows.select(F.col("track").alias("video"), "event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) / 1000) % 40000).cast("long").alias("t_ms"), F.col("event_id").alias("frame"), (F.col("event_id") % 4 - 1).cast("int").alias("speaker"))


def _votes(s, d):
    out = T.speaker_votes(_speakers(s, d), subtitles(s, d))
    return out.withColumn("speakers", F.array_join(F.transform("speakers", lambda x: x.cast("string")), ","))


def _speech_energy(s, d, width, rms):
    rows = observations(s, d)
    scaled = rows.withColumn("value", F.col("value") / (5000 if rms else 1) - (0 if rms else 50))
    return _round(T.speech_at(rows, T.segments(rows, _active()), scaled, width, rms).withColumn("energy", F.col("energy") + NUDGE), "energy")


def _boxes(s, d):
    x1, y1 = F.when(F.col("kind") != "error", F.col("value")), F.col("value") / 2
    return observations(s, d).select("track", "event_id", "ts", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("event_id") % 50 + 0.25).alias("x2"), (y1 + F.col("event_id") % 40 + 0.25).alias("y2"))


def _loud_faces(s, d):
    f = faces(s, d)
    energy = F.when(F.col("frame_num") % 7 > 1, (F.col("frame_num") * 37) % 101 / 10.0)
    return f.select(F.expr("frame_num div 100").alias("video"), "frame_num", "face_idx", F.col("cluster_id").alias("face"), energy.alias("energy"))


def _grid(s, d):
    rows = subtitles(s, d)
    starts = rows.select((F.col("start_ms") / 1000.0).alias("t"))
    marks = rows.where("idx > 0").select((F.col("start_ms") / 1000.0 + 0.62).alias("m")).distinct()
    return T.best_offset(starts, marks)


QUERIES = {
    "history_vote_fill": lambda s, d: _round(T.history_vote(_matched(s, d)), "filled_similarity"),
    "ema_smoothing": lambda s, d: _round(T.ema(observations(s, d)).withColumn("smooth", F.col("smooth") + NUDGE), "smooth"),
    "feedback_boost": lambda s, d: _round(T.feedback_boost(_scaled(s, d)).withColumn("adjusted", F.col("adjusted") + NUDGE), "adjusted"),
    "energy_smoothing": lambda s, d: _round(T.energy_smoothing(observations(s, d)).withColumn("smooth", F.col("smooth") + NUDGE).withColumn("mean", F.col("mean") + NUDGE), "smooth", "mean"),
    "consecutive_runs": lambda s, d: T.consecutive_runs(observations(s, d)),
    "speech_segments_v1": lambda s, d: _segments(s, d, end_rule="first_inactive", keep_tail=False),
    "speech_segments_v2": lambda s, d: _segments(s, d, end_rule="first_inactive", keep_tail=False, least_s=3600),
    "speech_segments_v3": lambda s, d: _segments(s, d, least_s=3600),
    "speech_onsets": lambda s, d: T.onsets(observations(s, d), _active()),
    "energy_thresholds": lambda s, d: _round(T.thresholds(observations(s, d)), "mean_std", "mad_3", "mad_25"),
    "frame_energy": lambda s, d: _round(T.frame_energy(observations(s, d).select(F.col("event_id").alias("i"), (F.col("value") / 100).alias("x"))), "energy", "rms"),
    "movement_variance": lambda s, d: _round(T.movement(observations(s, d), scale=0.0001), "movement", places=4),
    "speech_active_at": lambda s, d: T.inside_segments(observations(s, d), T.segments(observations(s, d), _active()), 600),
    "speech_energy_at": lambda s, d: _speech_energy(s, d, 1200, False),
    "speech_loudness_at": lambda s, d: _speech_energy(s, d, 7200, True),
    "box_smoothing": lambda s, d: T.smooth_boxes(_boxes(s, d)),
    "loudest_face": lambda s, d: _round(T.loudest_face(_loud_faces(s, d)).withColumn("mean", F.col("mean") + NUDGE), "mean"),
    "nearest_onset": lambda s, d: T.nearest(observations(s, d), T.onsets(observations(s, d), _active())),
    "offset_grid_search": lambda s, d: _round(_grid(s, d), "score"),
    "carry_forward": lambda s, d: T.carry_forward(observations(s, d), F.when(F.col("kind") == "click", F.col("value"))),
    "speaker_vote": _votes,
}

_O = OBSERVATIONS
_BY = "PARTITION BY track ORDER BY ts, event_id"
_I = f"a AS (SELECT *, value > {LOUD} AS act, lag(value > {LOUD}) OVER w AS bef, lead(ts) OVER w AS nxt FROM {_O} WINDOW w AS ({_BY})), i AS (SELECT *, sum(CASE WHEN act AND NOT coalesce(bef, false) THEN 1 ELSE 0 END) OVER ({_BY}) AS island FROM a)"
_SEG = "SELECT * FROM (SELECT track, island, min(ts) AS start, {end} AS \"end\", round((epoch_us({end}) - epoch_us(min(ts))) / 1e6, 3) AS duration, (epoch_us({end}) - epoch_us(min(ts))) / 1e6 AS dd, arg_max(nxt IS NULL, struct_pack(t := ts, e := event_id)) AS open FROM i WHERE act GROUP BY 1, 2)"
_FIRST = "arg_max(coalesce(nxt, ts), struct_pack(t := ts, e := event_id))"
_LASTROW = "max(ts)"


def _seg(end: str, more: str) -> str:
    return f"WITH {_I}, g AS ({_SEG.format(end=end)}) SELECT track, island, start, \"end\", duration FROM g WHERE {more}"


def _speech_sql(width: int, energy: str) -> str:
    return f"""WITH {_I}, g AS (SELECT track, min(ts) - INTERVAL {width} SECOND AS lo, max(ts) + INTERVAL {width} SECOND AS hi FROM i WHERE act GROUP BY track, island),
h AS (SELECT DISTINCT o.event_id FROM {_O} o JOIN g ON g.track = o.track AND o.ts BETWEEN lo AND hi),
m AS (SELECT o.track, o.event_id, {energy} AS energy FROM {_O} o JOIN {_O} e ON e.track = o.track AND e.ts BETWEEN o.ts - INTERVAL {width // 2} SECOND AND o.ts + INTERVAL {width // 2} SECOND GROUP BY 1, 2)
SELECT m.track, m.event_id, h.event_id IS NOT NULL AS active, round(CASE WHEN h.event_id IS NULL THEN 0 ELSE energy END + {NUDGE}, 6) AS energy FROM m LEFT JOIN h USING (event_id)"""


_EMA = f"WITH RECURSIVE n AS (SELECT *, row_number() OVER ({_BY}) AS r FROM {_O}), e AS (SELECT track, event_id, r, value AS smooth FROM n WHERE r = 1 UNION ALL SELECT n.track, n.event_id, n.r, {{a}} * n.value + {{b}} * e.smooth FROM e JOIN n ON n.track = e.track AND n.r = e.r + 1)"

ORACLE = {
    "history_vote_fill": f"""WITH m AS (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], kind) - 2 AS match, least(value / 100, 1.0) AS similarity, row_number() OVER ({_BY}) AS r FROM {_O}),
v AS (SELECT a.event_id, b.match, count(*) AS votes, min(b.r) AS first FROM m a JOIN m b ON a.track = b.track AND b.r BETWEEN a.r - 9 AND a.r - 1 AND b.match >= 0 AND b.similarity >= 0.45 GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY votes DESC, first) AS k FROM v) WHERE k = 1),
f AS (SELECT m.*, t.match AS top, coalesce((m.match < 0 OR similarity < 0.5) AND m.r >= 3 AND votes >= 3, false) AS fill FROM m LEFT JOIN t USING (event_id))
SELECT track, event_id, (CASE WHEN fill THEN top ELSE match END)::INT AS filled_match, round(CASE WHEN fill THEN greatest(similarity, 0.4) ELSE similarity END, 6) AS filled_similarity, fill AS from_history FROM f""",
    "ema_smoothing": _EMA.format(a=0.3, b=0.7) + f" SELECT track, event_id, round(smooth + {NUDGE}, 6) AS smooth FROM e",
    "feedback_boost": f"""WITH RECURSIVE n AS (SELECT track, event_id, least(value / 100, 1.0) AS v, row_number() OVER ({_BY}) AS r FROM {_O}),
e AS (SELECT track, event_id, r, v AS adj, CASE WHEN v > 0.5 THEN [v] ELSE []::DOUBLE[] END AS h FROM n WHERE r = 1
UNION ALL SELECT track, event_id, r, adj, CASE WHEN adj > 0.5 THEN list_concat([adj], h)[1:5] ELSE h END FROM (SELECT n.track, n.event_id, n.r, CASE WHEN len(e.h) > 0 THEN 0.7 * n.v + 0.3 * (list_reduce(e.h, lambda a, x: a + x) / len(e.h)) ELSE n.v END AS adj, e.h FROM e JOIN n ON n.track = e.track AND n.r = e.r + 1))
SELECT track, event_id, round(adj + {NUDGE}, 6) AS adjusted FROM e""",
    "energy_smoothing": _EMA.format(a=0.7, b=0.3) + f" SELECT track, event_id, round(smooth + {NUDGE}, 6) AS smooth, round(avg(smooth) OVER (PARTITION BY track ORDER BY r ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + {NUDGE}, 6) AS mean FROM e",
    "consecutive_runs": f"WITH a AS (SELECT *, CASE WHEN lag(kind) OVER ({_BY}) IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS x FROM {_O}), b AS (SELECT *, sum(x) OVER ({_BY}) AS g FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY track, g ORDER BY ts, event_id) AS run FROM b) SELECT track, event_id, run, run >= 3 AS stable FROM c",
    "speech_segments_v1": _seg(_FIRST, "NOT open"),
    "speech_segments_v2": _seg(_FIRST, "NOT open AND dd >= 3600"),
    "speech_segments_v3": _seg(_LASTROW, "dd >= 3600"),
    "speech_onsets": f"WITH {_I} SELECT track, event_id, ts FROM i WHERE act AND NOT coalesce(bef, false)",
    "energy_thresholds": f"SELECT track, round(avg(value) + 0.5 * stddev_pop(value), 6) AS mean_std, round(median(value) + 3 * mad(value), 6) AS mad_3, round(median(value) + 2.5 * mad(value), 6) AS mad_25 FROM {_O} GROUP BY 1",
    "frame_energy": "SELECT frame, count(*) AS n, round(sum(x * x), 6) AS energy, round(sqrt(sum(x * x) / count(*)), 6) AS rms FROM (SELECT event_id // 10 - k AS frame, value / 100 AS x FROM events, range(2) AS r(k)) WHERE frame >= 0 GROUP BY 1",
    "movement_variance": f"SELECT track, event_id, round(least(var_pop(value) OVER ({_BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 0.0001, 1), 4) AS movement FROM {_O}",
    "speech_active_at": f"WITH {_I}, g AS (SELECT track, island, min(ts) - INTERVAL 600 SECOND AS lo, max(ts) + INTERVAL 600 SECOND AS hi FROM i WHERE act GROUP BY 1, 2) SELECT o.track, o.event_id, min(g.island) AS island FROM {_O} o LEFT JOIN g ON g.track = o.track AND o.ts BETWEEN lo AND hi GROUP BY 1, 2",
    "speech_energy_at": _speech_sql(1200, "avg(abs(e.value - 50))"),
    "speech_loudness_at": _speech_sql(7200, "least(sqrt(avg((e.value / 5000) * (e.value / 5000))) * 10, 1.0)"),
    "box_smoothing": f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER ({_BY}) AS r, CASE WHEN kind <> 'error' THEN [value, value / 2, value + event_id % 50 + 0.25, value / 2 + event_id % 40 + 0.25]::DOUBLE[] END AS b FROM {_O}),
e AS (SELECT track, event_id, r, b AS s FROM n WHERE r = 1 UNION ALL SELECT n.track, n.event_id, n.r, CASE WHEN n.b IS NULL THEN e.s WHEN e.s IS NULL THEN n.b ELSE [0.3 * n.b[1] + 0.7 * e.s[1], 0.3 * n.b[2] + 0.7 * e.s[2], 0.3 * n.b[3] + 0.7 * e.s[3], 0.3 * n.b[4] + 0.7 * e.s[4]] END FROM e JOIN n ON n.track = e.track AND n.r = e.r + 1)
SELECT track, event_id, round_even(s[1], 0)::INT AS x1, round_even(s[2], 0)::INT AS y1, round_even(s[3], 0)::INT AS x2, round_even(s[4], 0)::INT AS y2 FROM e""",
    "loudest_face": f"""WITH RECURSIVE f AS (SELECT frame_num // 100 AS video, frame_num, face_id % 3 AS face_idx, cluster_id AS face, CASE WHEN frame_num % 7 > 1 THEN (frame_num * 37) % 101 / 10.0 END AS energy FROM {FACES}),
n AS (SELECT *, row_number() OVER (PARTITION BY video, face ORDER BY frame_num, face_idx) AS r FROM f WHERE energy IS NOT NULL),
e AS (SELECT video, face, frame_num, face_idx, r, energy::DOUBLE AS s FROM n WHERE r = 1 UNION ALL SELECT n.video, n.face, n.frame_num, n.face_idx, n.r, 0.7 * n.energy + 0.3 * e.s FROM e JOIN n ON n.video = e.video AND n.face = e.face AND n.r = e.r + 1),
m AS (SELECT *, avg(s) OVER (PARTITION BY video, face ORDER BY r ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM e),
a AS (SELECT video, frame_num, face, arg_max(mean, face_idx) AS mean, min(face_idx) AS face_idx FROM m GROUP BY 1, 2, 3)
SELECT video::INT AS video, frame_num, face_idx::INT AS face_idx, face, round(mean + {NUDGE}, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY video, frame_num ORDER BY mean DESC, face_idx) AS k FROM a WHERE mean > 0) WHERE k = 1""",
    "nearest_onset": f"WITH {_I}, g AS (SELECT track, ts FROM i WHERE act AND NOT coalesce(bef, false)) SELECT o.track, o.event_id, min(abs(epoch_us(o.ts) - epoch_us(g.ts))) AS distance FROM {_O} o LEFT JOIN g USING (track) GROUP BY 1, 2",
    "offset_grid_search": f"WITH s AS (SELECT start_ms / 1000.0 AS t, count(*) AS n FROM {SUBTITLES} GROUP BY 1), m AS (SELECT DISTINCT start_ms / 1000.0 + 0.62 AS m FROM {SUBTITLES} WHERE idx > 0), x AS (SELECT t, n, k, max(greatest(0, 1 - abs(t + k * 0.02::DOUBLE - m) / 0.5)) AS sc FROM s JOIN m ON m BETWEEN t - 5.5 AND t + 5.5, range(-250, 251) AS r(k) WHERE abs(t + k * 0.02 - m) < 0.5 GROUP BY 1, 2, 3) SELECT k::INT AS offset_step, round(score, 6) AS score FROM (SELECT k, round(sum(sc * n) / (SELECT sum(n) FROM s), 9) AS score FROM x GROUP BY 1) ORDER BY score DESC, k LIMIT 1",
    "carry_forward": f"SELECT track, event_id, last_value(CASE WHEN kind = 'click' THEN value END IGNORE NULLS) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM {_O}",
    "speaker_vote": f"""WITH f AS (SELECT track AS video, event_id AS frame, ((epoch_us(ts) // 1000) % 40000) AS t, (event_id % 4 - 1)::INT AS speaker FROM {_O}), v AS (SELECT s.video, s.idx, speaker, count(*) AS votes, min(frame) AS first FROM {SUBTITLES} s JOIN f ON f.video = s.video AND t BETWEEN start_ms AND end_ms WHERE speaker >= 0 GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, idx ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1), l AS (SELECT video, idx, string_agg(speaker::VARCHAR, ',' ORDER BY speaker) AS speakers FROM v GROUP BY 1, 2)
SELECT s.video, s.idx, coalesce(votes, 0) AS votes, speaker, coalesce(speakers, '') AS speakers FROM {SUBTITLES} s LEFT JOIN b USING (video, idx) LEFT JOIN l USING (video, idx)""",
}
