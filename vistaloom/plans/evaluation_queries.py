"""Queries over predictions and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistaloom.operators import evaluation as E
from vistaloom.operators import vectors as V
from vistaloom.sources.tables import EPISODES, FACES, episodes, faces, table
from vistaloom.plans.vector_queries import _C, _round


def _pairs(s, d):
    f = faces(s, d)
    found = V.match_to_center(f, V.centroids(f, "cluster_id"), 0.2)
    return f.select("face_id", F.col("label").alias("true_label")).join(found.select("face_id", F.col("match_idx").alias("pred_label")), "face_id")


def _metrics(s, d):
    return E.class_metrics(E.confusion(_pairs(s, d)))


def _episodes(s, d):
    return E.summary(episodes(s, d))


def _narrated(s, d):
    """Of _composition the first three priorities, and the accuracy over all orders."""
    orders = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("episode")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("accuracy"))
    return _composition(s, d).where("category < '4'"), orders


def _nudged(compared):
    """A little is added before rounding, so that means in another order of summation don't part at a half."""
    return compared.select("episode", *((F.col(c) + 1e-6).alias(c) for c in ("base", "target", "diff", "percent")))


def _methods(s, d):
    orders = table(s, d, "orders").where("o_orderstatus IN ('F', 'O')")
    return orders.groupBy(F.year("o_orderdate").alias("episode"), F.col("o_orderstatus").alias("method")).agg(F.avg("o_totalprice").alias("value"))


def _composition(s, d):
    orders = table(s, d, "orders")
    sizes = orders.groupBy(F.year("o_orderdate").alias("episode")).agg(F.count("*").alias("effective"))
    parts = orders.groupBy(F.year("o_orderdate").alias("episode"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("correct"))
    return parts.join(sizes, "episode")


def _spoken(s, d):
    labels = table(s, d, "labels")
    return labels.select(F.col("quality").alias("t"), F.col("toxic").alias("p"))


def _annotated(s, d):
    """Orders as annotations: the priority is the truth, the day of the month the guess; some are unknown or skipped, some without a status."""
    status = F.when(F.col("o_orderkey") % 7 == 0, "unknown").when(F.col("o_orderkey") % 5 == 0, "skipped").when(F.col("o_orderkey") % 3 > 0, "confirmed")
    return table(s, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("true_id"), (F.dayofmonth("o_orderdate") % 5 + 1).alias("predicted_id"), status.alias("status"))


QUERIES = {
    "accuracy_by_class": lambda s, d: _round(E.accuracy_by_class(_annotated(s, d)), "accuracy"),
    "confusion_long": lambda s, d: E.confusion(_pairs(s, d)),
    "confusion_matrix_wide": lambda s, d: E.confusion_wide(E.confusion(_pairs(s, d)), [-1, *range(10)]),
    "confusion_from_wide": lambda s, d: E.from_wide(E.confusion_wide(E.confusion(_pairs(s, d)), list(range(10))), "true_label"),
    "class_metrics": lambda s, d: _round(_metrics(s, d), "precision", "recall", "f1"),
    "classification_report": lambda s, d: _round(E.classification_report(_metrics(s, d)), "precision", "recall", "f1"),
    "best_worst_class": lambda s, d: _round(E.best_and_worst(_metrics(s, d)), "best_f1", "worst_f1"),
    "class_error_histogram": lambda s, d: E.error_histogram(_metrics(s, d)),
    "speaking_accuracy": lambda s, d: _round(E.accuracy(_spoken(s, d), "t", "p"), "accuracy"),
    "episode_summary": lambda s, d: _round(_episodes(s, d), "value", "accuracy", "error_rate"),
    "episode_stats": lambda s, d: _round(E.metric_stats(_episodes(s, d), "episode", ["accuracy", "error_rate", "value"]), "mean", "std", "min", "max"),
    "metric_correlation": lambda s, d: (c := _round(E.correlations(_episodes(s, d), ["accuracy", "value", "total"]), "r")).withColumn("strength", E.strength(F.col("r"))),
    "trend_line": lambda s, d: _round(E.trend(_episodes(s, d), "episode", "accuracy"), "slope", "intercept"),
    "outliers_2sigma": lambda s, d: _round(E.outliers(_episodes(s, d), "episode", "value"), "value", places=4),
    "consistency_band": lambda s, d: _round(E.consistency(_episodes(s, d), "accuracy"), "mean", "std", "cv"),
    "episode_ranking": lambda s, d: _round(E.ranking(_episodes(s, d), "episode", "accuracy"), "accuracy"),
    "moving_average": lambda s, d: _round(E.centred_average(_episodes(s, d), "episode", "accuracy"), "accuracy", "smooth"),
    "model_comparison": lambda s, d: _round(_nudged(E.compare_methods(_methods(s, d), ("F", "O"))), "base", "target", "diff", "percent", places=4),
    "error_composition": lambda s, d: _round(E.error_composition(_composition(s, d)), "error_rate", "impact", "all_impacts"),
    "unexplained_error": lambda s, d: _round(E.unexplained_error(*_narrated(s, d)), "total_error", "explained", "rest"),
    "metric_quartiles": lambda s, d: _round(E.quartiles(_episodes(s, d), "accuracy"), "q1", "q2", "q3"),
    "overall_success": lambda s, d: episodes(s, d).agg(F.round(F.sum("correct") / F.sum("total"), 6).alias("success")),
}

_PRED = f"x AS (SELECT face_id, label, cluster_id AS c, list_dot_product(enc, center) AS s FROM (SELECT face_id, label, enc FROM {FACES}), c), pr AS (SELECT label AS t, CASE WHEN s > 0.2 THEN c ELSE -1 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY s DESC, c) AS r FROM x) WHERE r = 1)"
_W = f"WITH {_C}, {_PRED}"
_M = f"""{_W}, lab AS (SELECT t AS label FROM pr UNION SELECT p FROM pr), mm AS (SELECT label, (SELECT count(*) FROM pr WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM pr WHERE p = label AND t <> label) AS fp, (SELECT count(*) FROM pr WHERE t = label AND p <> label) AS fn, (SELECT count(*) FROM pr WHERE t = label) AS support FROM lab),
m2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM mm), me AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m2)"""
_E = f"WITH ep AS (SELECT *, correct / total AS accuracy, 1 - correct / total AS error_rate, total - correct AS error_count FROM {EPISODES})"
_STAT = "SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max, (SELECT episode FROM ep ORDER BY {m} DESC, episode LIMIT 1) AS best, (SELECT episode FROM ep ORDER BY {m}, episode LIMIT 1) AS worst FROM ep"
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ep" for a in ("accuracy", "value", "total") for b in ("accuracy", "value", "total"))

ORACLE = {
    "confusion_long": f"{_W} SELECT t AS true_label, p AS pred_label, count(*) AS cnt FROM pr GROUP BY 1, 2",
    "confusion_matrix_wide": f"{_W} SELECT t AS true_label, " + ", ".join(f'count(*) FILTER (p = {x}) AS "p_{x}"' for x in [-1, *range(10)]) + " FROM pr GROUP BY 1",
    "confusion_from_wide": f"{_W} SELECT t AS true_label, 'p_' || x AS pred_label, count(*) FILTER (p = x) AS cnt FROM pr, range(10) AS r(x) GROUP BY 1, 2",
    "class_metrics": f"{_M} SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM me",
    "classification_report": f"{_M} SELECT label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM me UNION ALL SELECT 'Macro Avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM me WHERE support > 0 UNION ALL SELECT 'Weighted Avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM me WHERE support > 0",
    "best_worst_class": f"{_M} SELECT (SELECT label FROM me WHERE support > 0 ORDER BY f1 DESC, label LIMIT 1) AS best_label, (SELECT round(max(f1), 6) FROM me WHERE support > 0) AS best_f1, (SELECT label FROM me WHERE support > 0 ORDER BY f1, label LIMIT 1) AS worst_label, (SELECT round(min(f1), 6) FROM me WHERE support > 0) AS worst_f1",
    "class_error_histogram": f"{_M} SELECT least(floor(fn / support * 20) + 1, 20)::INT AS bin, count(*) AS classes FROM me WHERE support > 0 GROUP BY 1",
    "speaking_accuracy": "SELECT count(*) AS total, count(*) FILTER (quality = toxic) AS correct, round(count(*) FILTER (quality = toxic) / count(*), 6) AS accuracy FROM labels",
    "episode_summary": f"{_E} SELECT episode, total, correct, round(value, 6) AS value, round(accuracy, 6) AS accuracy, round(error_rate, 6) AS error_rate, error_count FROM ep",
    "episode_stats": f"{_E} " + " UNION ALL ".join(_STAT.format(m=m) for m in ("accuracy", "error_rate", "value")),
    "metric_correlation": f"{_E} SELECT *, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM ({_CORR})",
    "trend_line": f"{_E} SELECT round(regr_slope(accuracy, episode), 6) AS slope, round(regr_intercept(accuracy, episode), 6) AS intercept FROM ep",
    "outliers_2sigma": f"{_E} SELECT episode, round(value, 4) AS value FROM ep WHERE abs(value - (SELECT avg(value) FROM ep)) > 2 * (SELECT stddev_samp(value) FROM ep)",
    "consistency_band": f"{_E} SELECT round(m, 6) AS mean, round(sd, 6) AS std, round(sd * 100 / m, 6) AS cv, CASE WHEN sd * 100 < 5 THEN 'high' WHEN sd * 100 < 10 THEN 'moderate' ELSE 'low' END AS band_by_std, CASE WHEN sd * 100 / m < 10 THEN 'high' WHEN sd * 100 / m < 20 THEN 'moderate' ELSE 'low' END AS band_by_cv FROM (SELECT avg(accuracy) AS m, stddev_samp(accuracy) AS sd FROM ep)",
    "episode_ranking": f"{_E} SELECT episode, round(accuracy, 6) AS accuracy, rank, CASE WHEN rank <= 3 THEN 'top' WHEN rank > n - 3 THEN 'bottom' END AS place FROM (SELECT *, row_number() OVER (ORDER BY accuracy DESC, episode) AS rank, count(*) OVER () AS n FROM ep)",
    "moving_average": f"{_E} SELECT episode, round(accuracy, 6) AS accuracy, round(CASE WHEN count(*) OVER w = 3 THEN avg(accuracy) OVER w END, 6) AS smooth FROM ep WINDOW w AS (ORDER BY episode ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "model_comparison": "SELECT episode, round(b + 1e-6, 4) AS base, round(t + 1e-6, 4) AS target, round(t - b + 1e-6, 4) AS diff, round((t - b) / b * 100 + 1e-6, 4) AS percent FROM (SELECT year(o_orderdate) AS episode, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS b, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS t FROM orders GROUP BY 1)",
    "error_composition": "SELECT episode, category, round(error_rate, 6) AS error_rate, round(impact, 6) AS impact, round(sum(impact) OVER (PARTITION BY episode), 6) AS all_impacts FROM (SELECT year(o_orderdate) AS episode, o_orderpriority AS category, count(*) FILTER (o_orderstatus <> 'F') / count(*) AS error_rate, count(*) FILTER (o_orderstatus <> 'F') / sum(count(*)) OVER (PARTITION BY year(o_orderdate)) AS impact FROM orders GROUP BY 1, 2)",
    "unexplained_error": "SELECT episode, round(1 - a, 6) AS total_error, round(x, 6) AS explained, round(1 - a - x, 6) AS rest FROM (SELECT year(o_orderdate) AS episode, count(*) FILTER (o_orderstatus = 'F') / count(*) AS a, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority < '4') / count(*) AS x FROM orders GROUP BY 1)",
    "metric_quartiles": f"{_E} SELECT round(quantile_cont(accuracy, 0.25), 6) AS q1, round(quantile_cont(accuracy, 0.5), 6) AS q2, round(quantile_cont(accuracy, 0.75), 6) AS q3 FROM ep",
    "overall_success": f"{_E} SELECT round(sum(correct) / sum(total), 6) AS success FROM ep",
}
ORACLE["accuracy_by_class"] = """WITH a AS (SELECT substr(o_orderpriority, 1, 1)::INT AS t, day(o_orderdate) % 5 + 1 AS p, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'skipped' WHEN o_orderkey % 3 > 0 THEN 'confirmed' END AS status FROM orders),
k AS (SELECT * FROM a WHERE status IS NULL OR status NOT IN ('unknown', 'skipped'))
SELECT class, total, correct, round(correct / total, 6) AS accuracy FROM (SELECT t::VARCHAR AS class, count(*) AS total, count(*) FILTER (t = p) AS correct FROM k GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (t = p) FROM k)"""
