"""Queries that run as streams over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.plans.vector_queries import _round
from vistaloom.sources.tables import OBSERVATIONS
from vistaloom.streaming import tracks as S


def _events(s, d):
    return S.read_observations(s, f"{d}/events.parquet")


def _plain(df):
    return df.withColumn("start", F.unix_micros("start"))


def _carried(s, d):
    rows = _events(s, d).withColumn("value", F.when(F.col("kind") == "click", F.col("value")))
    return S.run_available(S.carried(rows, SILENT_MS), "append")


#: Half a day.
SILENT_MS = 12 * 3_600_000

QUERIES = {
    "stream_carry_forward": _carried,
    "stream_sliding_energy": lambda s, d: _round(_plain(S.run_available(S.sliding_energy(_events(s, d)))), "energy", places=3),
    "stream_sessions": lambda s, d: _plain(S.run_available(S.sessions(_events(s, d)))),
    "stream_track_state": lambda s, d: _round(S.run_available(S.smoothed(_events(s, d)), "update").groupBy("track").agg(F.max(F.struct("n", "smooth")).alias("x")).select("track", "x.*"), "smooth"),
}
ORACLE = {
    "stream_sliding_energy": f"SELECT (h - k) * 3600000000 AS start, count(*) AS n, round(sum(value * value), 3) AS energy FROM (SELECT epoch_us(ts) // 3600000000 AS h, value FROM {OBSERVATIONS}), range(2) AS r(k) GROUP BY 1",
    "stream_sessions": f"WITH a AS (SELECT track, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY track ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS x FROM {OBSERVATIONS}), b AS (SELECT *, sum(x) OVER (PARTITION BY track ORDER BY ts) AS g FROM a) SELECT track, min(epoch_us(ts)) AS start, count(*) AS n FROM b GROUP BY track, g",
    "stream_track_state": f"WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ts, event_id) AS r FROM {OBSERVATIONS}), e AS (SELECT track, r, value AS smooth FROM n WHERE r = 1 UNION ALL SELECT n.track, n.r, 0.3 * n.value + 0.7 * e.smooth FROM e JOIN n ON n.track = e.track AND n.r = e.r + 1) SELECT track, r AS n, round(smooth, 6) AS smooth FROM (SELECT *, max(r) OVER (PARTITION BY track) AS m FROM e) WHERE r = m",
}
_WAITED = "(SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"
ORACLE["stream_carry_forward"] = f"""WITH o AS (SELECT track, event_id, epoch_us(ts) AS t, CASE WHEN kind = 'click' THEN value END AS v FROM {OBSERVATIONS} WHERE epoch_us(ts) // 1000 < {_WAITED}),
a AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {SILENT_MS * 1000} THEN 0 ELSE 1 END AS fresh, coalesce(lead(t) OVER w, 1000 * {_WAITED}) AS next FROM o WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY t, event_id) AS run FROM a),
c AS (SELECT track, event_id, t, last_value(v IGNORE NULLS) OVER w AS carried, count(*) OVER w AS n, next FROM b WINDOW w AS (PARTITION BY track, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT track, event_id, t AS "at", carried, 'row' AS kind, n FROM c UNION ALL SELECT track, event_id, t, carried, 'expired', n FROM c WHERE next - t > {SILENT_MS * 1000}"""
