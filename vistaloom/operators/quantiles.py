"""Exact quantiles of groups of any size in two passes: a mergeable sketch brackets each quantile, then the values inside the bracket are ranked.

The sketch is combined before the shuffle and is all that is kept of a group. What lies in a bracket, some hundredths of a group, is
ranked by a scan over ranges of values, so no group's values are in one buffer. A bracket that misses its quantile, which the sketch's
bound rules out, would be widened to the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaloom.operators.scan import running_sums
from vistaloom.storage import written

#: Groups that are looked up by a broadcast at most; part of a group on each side of the quantile; the sketch is off by 1 / ACCURACY of a group's rows at most.
BROADCAST_GROUPS, SLACK, ACCURACY = 10_000, 0.01, 1000


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float], slack: float = SLACK) -> DataFrame:
    """keys, q0, q1, ..: the quantiles `at` of value in each group, between the two nearest values in proportion, as median() and percentile() define them.

    Null values don't count; groups without others, and those with a null key, have no row. NaN is larger than all numbers.
    """
    held = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").dropna(subset=keys)
    ends = [min(1.0, max(0.0, q + side * slack)) for q in at for side in (-1, 1)]
    groups = written(held.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_b")), "quantile-brackets")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    met = held.join(side, keys)
    tags = F.array(*(F.struct(F.lit(i).alias("i"), (F.col("_v") < F.get("_b", F.lit(2 * i))).alias("below"), F.col("_v").between(F.get("_b", F.lit(2 * i)), F.get("_b", F.lit(2 * i + 1))).alias("inside")) for i in range(len(at))))
    below = met.select(*keys, "_n", F.explode(tags).alias("_t")).groupBy(*keys, "_n", F.col("_t.i").alias("_i")).agg(F.count_if("_t.below").alias("_below"), F.count_if("_t.inside").alias("_m"))
    wish = F.get(F.array(*map(F.lit, at)), F.col("_i")) * (F.col("_n") - 1)
    wanted = below.withColumn("_k", wish).withColumn("_lo", F.floor("_k") - F.col("_below") + 1).withColumn("_hi", F.ceil("_k") - F.col("_below") + 1)
    wanted = written(wanted, "quantile-ranks")
    inside = met.select(*keys, "_v", F.explode(F.filter(tags, lambda t: t["inside"])).alias("_t")).select(*keys, F.col("_t.i").alias("_i"), "_v")
    ranked = running_sums(inside, [*keys, "_i"], ["_v"], {"_rank": F.lit(1)})
    few = F.broadcast(wanted) if groups.count() <= BROADCAST_GROUPS else wanted
    picked = ranked.join(few, [*keys, "_i"]).where("_rank = _lo OR _rank = _hi")
    both = picked.groupBy(*keys, "_i").agg(F.max(F.when(F.col("_rank") == F.col("_lo"), F.col("_v"))).alias("a"), F.max(F.when(F.col("_rank") == F.col("_hi"), F.col("_v"))).alias("b"), F.first("_k").alias("k"))
    share = F.col("k") - F.floor("k")
    each = both.withColumn("q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share))
    out = each.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(at))))
    missed = wanted.where("_lo < 1 OR _hi > _m").select(*keys).distinct()
    if slack < 1 and not missed.isEmpty():
        out = out.join(missed, keys, "left_anti").unionByName(quantiles(rows.join(missed, keys, "left_semi"), keys, value, at, 1.0))
    return out
