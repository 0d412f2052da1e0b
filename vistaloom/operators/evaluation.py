"""Confusion matrices, precision and recall, and statistics over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaloom.operators.quantiles import quantiles
from vistaloom.operators.scan import numbered
from vistaloom.storage import written


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(pairs: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """true_label, pred_label, cnt of observed pairs."""
    return pairs.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("cnt"))


def confusion_wide(long: DataFrame, labels: list) -> DataFrame:
    """A row for each true label, a column p_<label> for each predicted one; 0 where a pair never occurs."""
    return long.groupBy("true_label").agg(*(F.coalesce(F.sum(F.when(F.col("pred_label") == x, F.col("cnt"))), F.lit(0)).alias(f"p_{x}") for x in labels))


def from_wide(wide: DataFrame, true: str) -> DataFrame:
    """The long form of a wide matrix: true_label, pred_label, cnt."""
    return wide.unpivot(true, [c for c in wide.columns if c != true], "pred_label", "cnt").withColumnRenamed(true, "true_label")


def class_metrics(long: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 of every label that occurs on either side."""
    both = long.select(F.col("true_label").alias("label"), F.col("cnt").alias("t"), F.lit(0).alias("p"), F.when(F.col("true_label") == F.col("pred_label"), F.col("cnt")).otherwise(0).alias("d")).unionByName(
        long.select(F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.col("cnt").alias("p"), F.lit(0).alias("d")))
    sums = both.groupBy("label").agg(F.sum("d").alias("tp"), (F.sum("p") - F.sum("d")).alias("fp"), (F.sum("t") - F.sum("d")).alias("fn"), F.sum("t").alias("support"))
    tp = F.col("tp")
    out = sums.withColumn("precision", ratio(tp, tp + F.col("fp"))).withColumn("recall", ratio(tp, tp + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(metrics: DataFrame) -> DataFrame:
    """Rows of class_metrics with two more: Macro Avg (over labels with support) and Weighted Avg."""
    kinds = ["precision", "recall", "f1"]
    some = metrics.where("support > 0")
    detail = metrics.select(F.col("label").cast("string").alias("label"), *kinds, "support")
    macro = some.agg(F.lit("Macro Avg").alias("label"), *(F.coalesce(F.avg(k), F.lit(0.0)).alias(k) for k in kinds), F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    weighted = some.agg(F.lit("Weighted Avg").alias("label"), *(F.coalesce(F.sum(F.col(k) * F.col("support")) / F.sum("support"), F.lit(0.0)).alias(k) for k in kinds), F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    return detail.unionByName(macro).unionByName(weighted)


def best_and_worst(metrics: DataFrame) -> DataFrame:
    """best_label, worst_label by f1 over labels with support; ties to the smaller label."""
    some = metrics.where("support > 0")
    return some.agg(F.max(F.struct("f1", (-F.col("label")).alias("l"))).alias("b"), F.min(F.struct("f1", "label")).alias("w")).select(
        (-F.col("b.l")).alias("best_label"), F.col("b.f1").alias("best_f1"), F.col("w.label").alias("worst_label"), F.col("w.f1").alias("worst_f1"))


def error_histogram(metrics: DataFrame, bins: int = 20) -> DataFrame:
    """bin (1 to bins), classes: error rates of labels with support, in equal steps from 0 to 1."""
    rate = ratio(F.col("fn"), F.col("support"))
    return metrics.where("support > 0").groupBy(F.least(F.floor(rate * bins) + 1, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("classes"))


def accuracy(pairs: DataFrame, true: str, pred: str) -> DataFrame:
    return pairs.agg(F.count("*").alias("total"), F.count_if(F.col(true) == F.col(pred)).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def summary(episodes: DataFrame) -> DataFrame:
    """Adds accuracy, error_rate and error_count to (episode, total, correct)."""
    return episodes.withColumn("accuracy", ratio(F.col("correct"), F.col("total"))).withColumn("error_rate", 1 - F.col("accuracy")).withColumn("error_count", F.col("total") - F.col("correct"))


def metric_stats(table: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """metric, mean, std (of a sample), min, max, best, worst: a row for each metric; best and worst are keys, ties to the smaller."""
    long = table.unpivot(key, metrics, "metric", "value")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min(F.struct("value", key)).alias("lo"), F.max(F.struct("value", (-F.col(key)).alias("k"))).alias("hi"))
    return out.select("metric", "mean", "std", F.col("lo.value").alias("min"), F.col("hi.value").alias("max"), (-F.col("hi.k")).alias("best"), F.col(f"lo.{key}").alias("worst"))


def correlations(table: DataFrame, metrics: list[str]) -> DataFrame:
    """a, b, r of all pairs of metrics, in one pass."""
    pairs = [(a, b) for a in metrics for b in metrics]
    one = table.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")


def consistency(table: DataFrame, metric: str) -> DataFrame:
    """std and coefficient of variation in percent, with both of the bands in use: by std (5, 10) and by variation (10, 20)."""
    one = table.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    cv = ratio(F.col("std") * 100, F.col("mean"))
    band = lambda x, a, b: F.when(x < a, "high").when(x < b, "moderate").otherwise("low")
    return one.select("mean", "std", cv.alias("cv"), band(F.col("std") * 100, 5, 10).alias("band_by_std"), band(cv, 10, 20).alias("band_by_cv"))


def outliers(table: DataFrame, key: str, metric: str, sigmas: float = 2.0) -> DataFrame:
    """Rows whose metric lies outside mean +- sigmas * sample std. The limits are one row, joined to all."""
    limits = table.agg(F.avg(metric).alias("_m"), F.stddev_samp(metric).alias("_s"))
    return table.join(F.broadcast(limits), F.abs(F.col(metric) - F.col("_m")) > sigmas * F.col("_s")).select(key, metric)


def ranking(table: DataFrame, key: str, metric: str, ends: int = 3) -> DataFrame:
    """key, metric, rank (by metric, descending; ties by key) and place: top or bottom for the first and last `ends`."""
    ranked = written(numbered(table.select(key, metric), [F.desc(metric), key], "rank").withColumn("rank", F.col("rank") + 1), "ranked")
    return ranked.withColumn("place", F.when(F.col("rank") <= ends, "top").when(F.col("rank") > ranked.count() - ends, "bottom"))


def centred_average(table: DataFrame, key: str, metric: str) -> DataFrame:
    """key, metric, smooth: mean with both neighbours; null at the ends."""
    placed = written(numbered(table.select(key, metric), [key], "_n"), "placed")
    around = placed.select(F.explode(F.array(F.col("_n") - 1, F.col("_n"), F.col("_n") + 1)).alias("_n"), F.col(metric).alias("_v"))
    means = around.groupBy("_n").agg(F.avg("_v").alias("_mean"), F.count("_v").alias("_c"))
    return placed.join(means, "_n").select(key, metric, F.when(F.col("_c") == 3, F.col("_mean")).alias("smooth"))


def accuracy_by_class(marked: DataFrame, ignored: tuple[str, ...] = ("unknown", "skipped")) -> DataFrame:
    """class, total, correct, accuracy of annotations (true_id, predicted_id, status): those of an ignored status are left out, a null status isn't one.

    A row for each true_id (null is a class of its own; a null prediction is right there), and one of class `all`, with an accuracy of 0 if nothing is left.
    """
    kept = marked.where(~F.coalesce(F.col("status").isin(*ignored), F.lit(False)))
    right = F.count_if(F.col("true_id").eqNullSafe(F.col("predicted_id")))
    each = kept.groupBy(F.coalesce(F.col("true_id").cast("string"), F.lit("none")).alias("class")).agg(F.count("*").alias("total"), right.alias("correct"))
    whole = kept.agg(F.lit("all").alias("class"), F.count("*").alias("total"), right.alias("correct"))
    return each.unionByName(whole).withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def sample_efficiency(table: DataFrame) -> DataFrame:
    """episode, efficiency (weighted F1 in percent for each hundred samples), gap (weighted less macro F1, in percent), imbalanced: whether the mean gap of all episodes exceeds 10.

    table: episode, total, weighted_f1, macro_f1. Without samples there is no efficiency.
    """
    gap = (F.col("weighted_f1") - F.col("macro_f1")) * 100
    mean = table.agg(F.avg(gap).alias("_mean"))
    each = table.crossJoin(F.broadcast(mean))  # one row
    return each.select("episode", F.when(F.col("total") > 0, F.col("weighted_f1") * 100 / (F.col("total") / 100)).alias("efficiency"), gap.alias("gap"), F.coalesce(F.col("_mean") > 10, F.lit(False)).alias("imbalanced"))


def log_counts(confusion: DataFrame, count: str = "n") -> DataFrame:
    """confusion with log_count: log10 of the count and one, which shows rare cells beside frequent ones."""
    return confusion.withColumn("log_count", F.log10(F.col(count) + 1))


def trend(table: DataFrame, x: str, y: str) -> DataFrame:
    return table.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def compare_methods(table: DataFrame, methods: tuple[str, str]) -> DataFrame:
    """(episode, method, value) -> episode, both values, difference, and difference in percent of the first."""
    a, b = methods
    wide = table.groupBy("episode").pivot("method", [a, b]).agg(F.first("value"))
    return wide.select("episode", F.col(a).alias("base"), F.col(b).alias("target"), (F.col(b) - F.col(a)).alias("diff"), ((F.col(b) - F.col(a)) / F.col(a) * 100).alias("percent"))


def error_composition(table: DataFrame) -> DataFrame:
    """(episode, category, total, correct, effective) -> error rate and impact of each category, with the sum of the episode's impacts."""
    error = F.col("total") - F.col("correct")
    rows = table.select("episode", "category", ratio(error, F.col("total")).alias("error_rate"), ratio(error, F.col("effective")).alias("impact"))
    return rows.withColumn("all_impacts", F.sum("impact").over(Window.partitionBy("episode")))


def unexplained_error(table: DataFrame, overall: DataFrame) -> DataFrame:
    """episode, total_error, explained, rest: what the categories of error_composition leave of the error rate 1 - accuracy of overall (episode, accuracy)."""
    explained = error_composition(table).groupBy("episode").agg(F.sum("impact").alias("explained"))
    total = 1 - F.col("accuracy")
    return overall.join(explained, "episode").select("episode", total.alias("total_error"), "explained", (total - F.col("explained")).alias("rest"))


def quartiles(table: DataFrame, metric: str) -> DataFrame:
    found = quantiles(table.select(F.lit(0).alias("_all"), metric), ["_all"], metric, [0.25, 0.5, 0.75])
    return found.select(*(F.col(f"q{i}").alias(f"q{i + 1}") for i in range(3)))
