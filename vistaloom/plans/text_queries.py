"""Queries over subtitles, documents and rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.functions import texts as X
from vistaloom.operators import rules as R
from vistaloom.operators import subtitles as S
from vistaloom.operators.temporal import carry_forward
from vistaloom.plans.vector_queries import _round
from vistaloom.sources.tables import OBSERVATIONS, SUBTITLES, observations, subtitles, table
from vistaloom.sources.trees import read_metrics_tree, report_fields
from vistaloom.storage import place

#: Labels and their numbers, as text labels map in a report.
LABELS = {"click": 1, "view": 2, "purchase": 3}


def _dialogues(s, d):
    return subtitles(s, d).withColumn("text", F.concat(F.lit("- "), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(".\n- "))))


def _gated(s, d):
    docs = table(s, d, "documents")
    words = F.size(F.split("text", " "))
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    rules = {"few_words": words < 20, "few_letters": letters * 2 < F.col("n_chars"), "long_words": F.col("n_chars") > words * 9, "many_lines": F.length(F.regexp_replace("text", "[^\n]", "")) > 40}
    return R.gate(docs, rules, ("too_short", F.col("n_chars") < 40)).select("doc_id", "is_valid", "reason")


def _scored(s, d):
    e = observations(s, d)
    x, y = (F.col("event_id") % 100) / 100.0, (F.col("event_id") % 37) / 37.0
    area, move = (F.col("event_id") % 13) / 200.0, F.least(F.col("value") / 200, F.lit(1.0))
    audio = F.when(F.col("kind") == "click", (F.col("event_id") % 7) / 7.0)
    return e.select(
        "track", "event_id", "kind", R.position_score(x, y).alias("position"), R.position_score_split(x, y).alias("position_split"), R.size_score(area).alias("size"),
        R.likelihood(move, R.position_score(x, y), R.size_score(area), audio).alias("likelihood"), R.likelihood_v2(move, R.position_score_split(x, y), R.size_score(area), audio).alias("likelihood_v2"))


def _top(s, d, loud, quiet):
    rows = _scored(s, d).select("track", "event_id", F.round("likelihood", 9).alias("score"))
    return _round(R.top_with_floor_and_cap(rows, "track", "score", "event_id", F.col("track") % 2 == 0, loud, quiet), "score")


def _matches(s, d, kinds):
    e = observations(s, d).where(F.col("kind").isin(*kinds))
    return e.select((F.col("event_id") % 500).alias("frame"), F.col("track").alias("center_id"), (F.col("value") / 500).alias("similarity"))


def _reports(s, d):
    e = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    body = F.format_string("Total samples: %s\nCorrect predictions: %s\nAverage metrics:\n  Macro Average:\n    Precision: %.4f\n    Recall: 0.8900\n  Weighted Average:\n    Precision: 0.9720\n    F1-Score: %.4f\n", F.format_number("n", 0), F.format_number("c", 0), F.col("c") / F.col("n"), F.col("c") / (F.col("n") + 1))
    return e.select(F.format_string("result_ep%d", "y").alias("name"), body.alias("report"))


def _parsed(s, d):
    r = F.col("report")
    return _reports(s, d).select(
        X.episode_number(F.col("name")).alias("episode"), X.report_number(r, "Total samples").cast("long").alias("total"), X.report_number(r, "Correct predictions").cast("long").alias("correct"),
        X.report_section_number(r, "Macro Average", "Precision").alias("macro_precision"), X.report_section_number(r, "Weighted Average", "F1-Score").alias("weighted_f1"), X.report_section_number(r, "Nothing", "Recall").alias("missing"))


#: The years that the tree is asked for; it holds more, and not all of these.
_YEARS = (1993, 1994, 1996, 2050)


def _metrics_tree(s, d):
    """Reports written as a tree of methods (order states) and episodes (years), of which two methods and some episodes are read back."""
    made = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("method"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") % 2 == 0).alias("c"))
    share = F.col("n") / (F.col("n") + F.col("y"))
    body = F.format_string(
        "Total samples: %d\nCorrect predictions: %d\nOverall Accuracy: %.4f\n\nMacro Average:\n  Precision: %.4f\n  Recall: %.4f\n  F1-Score: %.4f\n\nWeighted Average:\n  Precision: %.4f\n  Recall: %.4f\n\nBest performing class: %.1f\nF1-Score: 9.9\nWorst performing class: %.1f\n",
        "n", "c", share, share / 2, share / 3, share / 4, share / 5, share / 6, F.col("y") % 10 + 0.5, F.col("y") % 7 + 0.0)
    path = place(s, "metrics-tree")
    made.select("method", F.format_string("result_ep%d", "y").alias("folder"), body.alias("value")).write.partitionBy("method", "folder").text(path)
    found = read_metrics_tree(s, path, ["method=F", "method=O", "method=none"], [f"folder=result_ep{y}" for y in _YEARS], "*.txt")
    return found.select(F.substring("method", 8, 99).alias("method"), "episode", *(c.alias(n) for n, c in report_fields(F.col("report")).items()))


def _round_trip(s, d):
    """Subtitles written as SRT text and parsed again."""
    return S.parse_blocks(S.to_blocks(subtitles(s, d).withColumn("text", F.regexp_replace("text", r"\n\s*\n", "\n")))).select("video", "idx", "start_ms", "end_ms")


def _annotations(s, d):
    subs = S.context_or_dialogue(subtitles(s, d))
    return subs.select("video", F.concat(F.col("idx").cast("string"), F.lit("_start")).alias("key"), F.to_json(F.struct(F.col("idx").alias("subtitle_id"), F.col("start_ms").alias("timestamp"), "status")).alias("value"))


def _shown(s, d):
    moments = subtitles(s, d).select("video", (F.col("start_ms") + 300).alias("t_ms"))
    return S.shown_at(moments.distinct(), subtitles(s, d))


QUERIES = {
    "split_dialogues": lambda s, d: S.split_dialogues(_dialogues(s, d)),
    "split_report": lambda s, d: S.split_report(S.split_dialogues(_dialogues(s, d))).select("video", "original_index", "parts", F.md5("text").alias("text_md5")),
    "context_vs_dialogue": lambda s, d: S.context_or_dialogue(subtitles(s, d)).select("video", "idx", "start_ms", "end_ms", "status"),
    "display_subtitle_at_time": _shown,
    "srt_time_roundtrip": lambda s, d: subtitles(s, d).select("video", "idx", X.format_time(F.col("start_ms")).alias("shown"), X.parse_time(X.format_time(F.col("start_ms"))).alias("parsed")),
    "srt_file_roundtrip": _round_trip,
    "wrap_text": lambda s, d: subtitles(s, d).select("video", "idx", X.wrap(F.regexp_replace("text", "\n", " "), 40).alias("l")).select("video", "idx", F.size("l").alias("n"), F.array_join("l", "|").alias("lines")),
    "clean_subtitle_text": lambda s, d: subtitles(s, d).where(~F.col("idx").isin(3, 5)).select("video", "idx", X.clean(F.col("text")).alias("text"), F.coalesce("role", F.lit("None")).alias("speaker")),
    "remap_labels": lambda s, d: observations(s, d).select("event_id", X.remap(F.when(F.col("event_id") % 3 == 0, F.concat((F.col("event_id") % 50).cast("string"), F.lit(".0"))).otherwise(F.col("kind")), LABELS).alias("label")),
    "json_annotations": _annotations,
    "quality_gate": lambda s, d: _gated(s, d).withColumn("reason", F.array_join("reason", ",")),
    "quality_reason_histogram": lambda s, d: R.reason_histogram(_gated(s, d)),
    "linear_scores": lambda s, d: _round(_scored(s, d).drop("kind").withColumns({c: F.col(c) + 1e-9 for c in ("likelihood", "likelihood_v2")}), "position", "position_split", "size", "likelihood", "likelihood_v2"),
    "topk_floor_cap_v1": lambda s, d: _top(s, d, (0.3, 2, 3), (0.2, 3, 3)),
    "topk_floor_cap_v2": lambda s, d: _top(s, d, (0.85, 2, 2), (0.9, 3, 3)),
    "largest_per_frame": lambda s, d: R.largest(table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("id"), "l_quantity"), "l_orderkey", "l_quantity", "id", 10.0, 5),
    "best_match_per_frame": lambda s, d: _round(R.repaired(_matches(s, d, ["click", "view"]), _matches(s, d, ["none"])), "similarity"),
    "repair_results": lambda s, d: _round(R.repaired(_matches(s, d, ["click"]), _matches(s, d, ["view"])), "similarity"),
    "repair_results_frames_first": lambda s, d: _round(R.repaired(_matches(s, d, ["purchase"]), _matches(s, d, ["view"]), False), "similarity"),
    "metrics_text_parse": _parsed,
    "metrics_tree": _metrics_tree,
    "missing_centers": lambda s, d: observations(s, d).select("track").distinct().join(observations(s, d).where("value > 300").select("track").distinct(), "track", "left_anti"),
    "kind_carried": lambda s, d: carry_forward(observations(s, d), F.when(F.col("value") > 100, F.col("kind"))),
}

_D = f"(SELECT video, idx, start_ms, end_ms, '- ' || replace(replace(text, chr(10), ' '), '. ', '.' || chr(10) || '- ') AS text FROM {SUBTITLES})"
_SPLIT = f"""l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '-')) AS hy FROM {_D}),
p AS (SELECT *, CASE WHEN len(hy) >= 2 THEN hy ELSE [text] END AS p FROM l), q AS (SELECT *, len(p) AS parts, CASE WHEN len(p) = 1 THEN 0 WHEN end_ms - start_ms - 150 * (len(p) - 1) > 0 THEN 150 ELSE 50 END AS gap FROM p),
r AS (SELECT video, idx AS original_index, start_ms, parts, gap, greatest(end_ms - start_ms - gap * (parts - 1), 0) AS room, i - 1 AS part, p[i] AS text, greatest(length(regexp_replace(p[i], '[\\s?!,.]', '', 'g')), 1) AS len FROM q, unnest(range(1, parts + 1)) AS u(i)),
t AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY video, original_index ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(len) OVER (PARTITION BY video, original_index) AS a FROM r)"""
_GATE = """g AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS w, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^\n]', '', 'g')) AS nl FROM documents),
h AS (SELECT doc_id, CASE WHEN n_chars < 40 THEN ['too_short'] ELSE list_filter([CASE WHEN w < 20 THEN 'few_words' END, CASE WHEN letters * 2 < n_chars THEN 'few_letters' END, CASE WHEN n_chars > w * 9 THEN 'long_words' END, CASE WHEN nl > 40 THEN 'many_lines' END], lambda x: x IS NOT NULL) END AS reason FROM g)"""
_S = f"""s0 AS (SELECT track, event_id, kind, (event_id % 100) / 100.0::DOUBLE AS x, (event_id % 37) / 37.0::DOUBLE AS y, (event_id % 13) / 200.0::DOUBLE AS area, least(value / 200, 1.0) AS move, CASE WHEN kind = 'click' THEN (event_id % 7) / 7.0::DOUBLE END AS audio FROM {OBSERVATIONS}),
s1 AS (SELECT *, greatest(0, 1 - 1.5 * sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5))) AS position, 0.6 * greatest(0, 1 - 2 * abs(x - 0.5)) + 0.4 * (CASE WHEN y < 0.67 THEN 1 ELSE greatest(0.3, 1 - 2 * (y - 0.67)) END) AS position_split, least(1, area / 0.05) AS size FROM s0),
s2 AS (SELECT *, CASE WHEN audio IS NULL THEN 0.5 * move + 0.25 * position + 0.25 * size ELSE least(1, 0.5 * move + 0.25 * position + 0.25 * size + 0.3 * audio) END AS likelihood, 0.45 * move + 0.25 * position_split + 0.2 * size + CASE WHEN audio IS NULL THEN 0 ELSE 0.1 * least(1, 2 * audio) END AS likelihood_v2 FROM s1)"""


def _top_sql(loud, quiet):
    pick = [f"CASE WHEN track % 2 = 0 THEN {a} ELSE {b} END" for a, b in zip(loud, quiet)]
    return f"WITH {_S}, a AS (SELECT track, event_id, round(likelihood, 9) AS score FROM s2), b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, event_id) AS rank, count(*) FILTER (score > {pick[0]}) OVER (PARTITION BY track) AS k FROM a) SELECT track, event_id, round(score, 6) AS score, rank FROM b WHERE (CASE WHEN k < {pick[1]} THEN rank <= {pick[2]} ELSE score > {pick[0]} END) AND rank <= 8"


def _best_sql(kinds):
    return f"(SELECT frame, center_id, similarity FROM (SELECT event_id % 500 AS frame, track AS center_id, value / 500 AS similarity, row_number() OVER (PARTITION BY event_id % 500 ORDER BY value DESC, track) AS r FROM {OBSERVATIONS} WHERE kind IN ({kinds})) WHERE r = 1)"


def _repair_sql(a, b, better):
    return f"SELECT coalesce(a.frame, b.frame) AS frame, CASE WHEN {better} THEN b.center_id ELSE a.center_id END AS center_id, round(CASE WHEN {better} THEN b.similarity ELSE a.similarity END, 6) AS similarity FROM {_best_sql(a)} a FULL JOIN {_best_sql(b)} b ON a.frame = b.frame"


_SHOWN = f"c AS (SELECT video, idx, start_ms, CASE WHEN end_ms - start_ms < 1000 THEN start_ms + 5000 ELSE end_ms END AS end_ms, CASE WHEN end_ms - start_ms < 1000 THEN 'context_note' ELSE 'standard' END AS status FROM {SUBTITLES})"
_STAMP = "printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000)"

ORACLE = {
    "split_dialogues": f"WITH {_SPLIT} SELECT video, row_number() OVER (PARTITION BY video ORDER BY original_index, part) AS idx, original_index, part + 1 AS part, parts, (start_ms + floor(room * b / a) + part * gap)::BIGINT AS start_ms, (start_ms + floor(room * (b + len) / a) + part * gap)::BIGINT AS end_ms, text FROM t",
    "split_report": f"WITH {_SPLIT} SELECT video, original_index, count(*) AS parts, md5(string_agg(text, ' / ' ORDER BY part)) AS text_md5 FROM t WHERE parts > 1 GROUP BY 1, 2",
    "context_vs_dialogue": f"WITH {_SHOWN} SELECT * FROM c",
    "display_subtitle_at_time": f"WITH {_SHOWN}, m AS (SELECT DISTINCT video, start_ms + 300 AS t_ms FROM {SUBTITLES}), h AS (SELECT video, t_ms, idx, status, row_number() OVER (PARTITION BY video, t_ms, status ORDER BY start_ms, idx) AS r FROM m JOIN c USING (video) WHERE t_ms BETWEEN start_ms AND end_ms) SELECT video, t_ms, idx, status FROM h WHERE status = 'context_note' OR r = 1",
    "srt_time_roundtrip": f"SELECT video, idx, {_STAMP} AS shown, start_ms AS parsed FROM {SUBTITLES}",
    "srt_file_roundtrip": f"SELECT video, idx, start_ms, end_ms FROM {SUBTITLES}",
    "wrap_text": f"""WITH RECURSIVE w AS (SELECT video, idx, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM {SUBTITLES}),
f AS (SELECT video, idx, ws, 1 AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS lines FROM w UNION ALL
SELECT video, idx, ws, i + 1, CASE WHEN length(trim(cur || ' ' || ws[i], ' ')) <= 40 THEN trim(cur || ' ' || ws[i], ' ') ELSE ws[i] END, CASE WHEN length(trim(cur || ' ' || ws[i], ' ')) <= 40 THEN lines ELSE list_append(lines, cur) END FROM f WHERE i <= len(ws))
SELECT video, idx, len(l) AS n, array_to_string(l, '|') AS lines FROM (SELECT video, idx, CASE WHEN cur <> '' THEN list_append(lines, cur) ELSE lines END AS l FROM f WHERE i = len(ws) + 1)""",
    "clean_subtitle_text": f"SELECT video, idx, CASE WHEN trim(replace(coalesce(text, ''), chr(10), ' '), ' ') = '' THEN '[EMPTY_TEXT]' ELSE trim(replace(coalesce(text, ''), chr(10), ' '), ' ') END AS text, coalesce(role, 'None') AS speaker FROM {SUBTITLES} WHERE idx NOT IN (3, 5)",
    "remap_labels": f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::INT WHEN kind = 'click' THEN 1 WHEN kind = 'view' THEN 2 WHEN kind = 'purchase' THEN 3 END AS label FROM {OBSERVATIONS}",
    "json_annotations": f"WITH {_SHOWN} SELECT video, idx || '_start' AS key, '{{\"subtitle_id\":' || idx || ',\"timestamp\":' || start_ms || ',\"status\":\"' || status || '\"}}' AS value FROM c",
    "quality_gate": f"WITH {_GATE} SELECT doc_id, len(reason) = 0 AS is_valid, array_to_string(reason, ',') AS reason FROM h",
    "quality_reason_histogram": f"WITH {_GATE} SELECT r AS reason, count(*) AS n FROM h, unnest(reason) AS u(r) GROUP BY 1",
    "linear_scores": f"WITH {_S} SELECT track, event_id, round(position, 6) AS position, round(position_split, 6) AS position_split, round(size, 6) AS size, round(likelihood + 1e-9, 6) AS likelihood, round(likelihood_v2 + 1e-9, 6) AS likelihood_v2 FROM s2",
    "topk_floor_cap_v1": _top_sql((0.3, 2, 3), (0.2, 3, 3)),
    "topk_floor_cap_v2": _top_sql((0.85, 2, 2), (0.9, 3, 3)),
    "largest_per_frame": "SELECT l_orderkey, id, l_quantity, rank FROM (SELECT l_orderkey, l_partkey * 100 + l_linenumber AS id, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 100 + l_linenumber) AS rank FROM lineitem WHERE l_quantity >= 10) WHERE rank <= 5",
    "best_match_per_frame": f"SELECT frame, center_id, round(similarity, 6) AS similarity FROM {_best_sql(chr(39) + 'click' + chr(39) + ',' + chr(39) + 'view' + chr(39))}",
    "repair_results": _repair_sql("'click'", "'view'", "(a.frame IS NULL OR coalesce(b.similarity > a.similarity, false))"),
    "repair_results_frames_first": _repair_sql("'purchase'", "'view'", "a.frame IS NULL"),
    "metrics_text_parse": "SELECT y::INT AS episode, n AS total, c AS correct, round(c / n, 4) AS macro_precision, round(c / (n + 1), 4) AS weighted_f1, 0.0::DOUBLE AS missing FROM (SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1)",
    "missing_centers": f"SELECT DISTINCT track FROM {OBSERVATIONS} WHERE track NOT IN (SELECT track FROM {OBSERVATIONS} WHERE value > 300)",
    "kind_carried": f"SELECT track, event_id, last_value(CASE WHEN value > 100 THEN kind END IGNORE NULLS) OVER (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM {OBSERVATIONS}",
}
ORACLE["metrics_tree"] = f"""WITH m AS (SELECT o_orderstatus AS method, year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_custkey % 2 = 0) AS c, count(*) / (count(*) + year(o_orderdate)) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') AND year(o_orderdate) IN {_YEARS} GROUP BY 1, 2)
SELECT method, y::INT AS episode, n AS total_samples, c AS correct_predictions, round(s, 4) AS overall_accuracy, round(s / 5, 4) AS weighted_precision, round(s / 6, 4) AS weighted_recall, NULL::DOUBLE AS weighted_f1,
round(s / 2, 4) AS macro_precision, round(s / 3, 4) AS macro_recall, round(s / 4, 4) AS macro_f1, y % 10 + 0.5::DOUBLE AS best_class, (y % 7)::DOUBLE AS worst_class FROM m"""
