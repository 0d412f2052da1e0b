"""Points inside intervals, and means around points, without every row of a key meeting every interval of it.

An interval is kept in the bins of a width that suits its own length: a power of four not below it, so it lies in two bins at most. A point looks into one bin of
each width that occurs. Short and long intervals thus don't disturb each other, whatever the mixture, and a row only meets intervals
that are about as near as they are long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaloom.operators.scan import running_sums


#: Bits of a part of a value; sums of so many parts as a long holds beside them, 2**27, are whole.
PART = 36


def _level(length: Column) -> Column:
    """The exponent, even, of the least power of four that is not below length + 1."""
    return (F.ceil(F.log2(F.greatest(length, F.lit(0)) + 1) / 2 - 1e-12) * 2).cast("int")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """points joined with intervals of equal keys where lo <= at <= hi (longs); apart from the keys no column may be on both sides.

    Intervals whose end is before their start, and nulls, meet nothing. The widths that occur, a few dozen at most, are asked for first.
    """
    known = intervals.where(F.col(hi) >= F.col(lo)).withColumn("_level", _level(F.col(hi) - F.col(lo)))
    levels = sorted(r["_level"] for r in known.select("_level").distinct().collect())  # 32 at most
    bin_of = lambda column: F.expr(f"shiftright({column}, _level)")
    dealt = known.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(lo), bin_of(hi)))))
    asking = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(at))
    return asking.join(dealt, [*keys, "_level", "_bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_level", "_bin")


def means_around(points: DataFrame, samples: DataFrame, keys: list[str], name: str, at: str, width: int, value: Column) -> DataFrame:
    """keys, name, mean, n: over the samples (keys, at) of a point's keys from width / 2 before the point (keys, name, at) to width / 2 after it, both included.

    Sums along time, one scan over samples and the two ends of each point's window, whose difference is the window's sum. Sums are of whole numbers, two parts of
    PART bits to a value, so that what lies before a window leaves no trace in it: values count to 72 bits below the largest. Not finite ones are counted by kind.
    Null without samples.
    """
    half = width // 2
    own = samples.select(*keys, F.lit(None).cast(points.schema[name].dataType).alias(name), F.col(at).cast("long").alias("_t"), F.lit(1).alias("_side"), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    finite = F.abs("_v") < float("inf")
    largest, odd = own.agg(F.max(F.when(finite, F.abs("_v"))), F.count_if(~finite)).first()
    unit = math.ldexp(1.0, max(math.frexp(largest or 0.0)[1] - PART, -900))
    end = lambda side, move: points.select(*keys, name, (F.col(at) + move).cast("long").alias("_t"), F.lit(side).alias("_side"), F.lit(0.0).alias("_v"))
    both = own.unionByName(end(0, -half)).unionByName(end(2, half))
    left, parts = F.when(finite, F.col("_v") / unit).otherwise(0.0), {}
    for part in ("_high", "_low"):
        parts[part] = left.cast("long")
        left = (left - parts[part].cast("double")) * float(1 << PART)
    parts["_count"] = (F.col("_side") == 1).cast("long")
    if odd:
        parts |= {"_nan": F.isnan("_v").cast("long"), "_up": (F.col("_v") == float("inf")).cast("long"), "_down": (F.col("_v") == float("-inf")).cast("long")}
    summed = running_sums(both, keys, ["_t", "_side"], parts)
    sides = summed.where("_side <> 1").groupBy(*keys, name).agg(*(F.sum(F.when(F.col("_side") == 2, F.col(c)).otherwise(-F.col(c))).alias(c) for c in parts))
    total = (F.col("_high").cast("double") + F.col("_low").cast("double") / float(1 << PART)) * unit
    if odd:
        total = total + F.when(F.col("_nan") > 0, float("nan")).otherwise(0.0) + F.when(F.col("_up") > 0, float("inf")).otherwise(0.0) - F.when(F.col("_down") > 0, float("inf")).otherwise(0.0)
    return sides.select(*keys, name, F.when(F.col("_count") > 0, total / F.col("_count")).alias("mean"), F.col("_count").alias("n"))
