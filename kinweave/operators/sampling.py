"""Audit samples: quotas, seeded draws and weighted precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .joins import hot_keys, skew_left_join


def hamilton(sizes: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """(stratum, quota): largest-remainder shares of ``n``, in whole numbers; ties by size, then name.

    ``sizes`` has one row per stratum.
    """
    total = sizes.agg(F.sum(size).alias("__t"))
    s = sizes.crossJoin(F.broadcast(total)).select(stratum, F.col(size).alias("z"), F.floor(F.lit(n) * F.col(size) / F.col("__t")).alias("base"), ((F.lit(n) * F.col(size)) % F.col("__t")).alias("rest"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), F.desc("z"), stratum))
    return s.select(stratum, (F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Seeded draw without replacement: the ``quota`` rows of smallest hash per stratum.

    The order depends on seed and key only, so a sample is stable under any
    partitioning. Before rows are ranked, a hash threshold a little above the share
    a quota has of its stratum drops the rest where they are read; a stratum that
    comes out short of its quota is ranked whole, so the draw is exact.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    x = df.filter(F.col(stratum).isNotNull()).withColumn("__h", h)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    q = F.col("quota").cast("double")
    # six standard deviations and some above the expected number
    bound = quotas.join(sizes, stratum).select(stratum, "quota", F.least("quota", "__n").alias("__due"), F.least(F.lit(1.0), (q + 6 * F.sqrt(q) + 20) / F.col("__n")).alias("__t"))
    place = (F.col("__h") / float(1 << 63) + 1) / 2
    kept = skew_left_join(x, bound, stratum, hot_keys(x, stratum), "inner").filter(place <= F.col("__t"))
    short = bound.join(kept.groupBy(stratum).agg(F.count(F.lit(1)).alias("__k")), stratum, "left").filter(F.coalesce("__k", F.lit(0)) < F.col("__due")).select(stratum, F.lit(True).alias("__short"), F.col("quota").alias("__q"))
    first = kept.join(short.select(stratum), stratum, "left_anti").select(*df.columns, "__h", "quota")
    again = skew_left_join(x, short, stratum, hot_keys(x, stratum), "inner").select(*df.columns, "__h", F.col("__q").alias("quota"))
    ranked = first.unionByName(again).withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key)))
    return ranked.filter(F.col("__r") <= F.col("quota")).select(*df.columns)


def label_scores(df: DataFrame, stratum: str, hit: str) -> DataFrame:
    """(stratum, n, hits, precision, lo, hi) per stratum and, as ``(all)``, overall."""
    agg = df.filter(F.col(hit).isNotNull()).rollup(stratum).agg(F.grouping(stratum).alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return agg.select(F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col(stratum)).alias("stratum"), "n", "hits", F.round(F.try_divide(F.col("hits"), F.col("n")), 9).alias("precision"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def weighted_precision(scores: DataFrame, weights: DataFrame, stratum: str, size: str) -> DataFrame:
    """One row: precision weighted by stratum size; a stratum judged whole has no sampling error."""
    j = scores.join(weights, stratum)
    whole = F.col("n") >= F.col(size)
    w = F.col(size) / F.sum(size).over(Window.partitionBy())
    x = j.withColumn("w", w)
    part = lambda c: F.sum(F.col("w") * F.when(whole, F.col("precision")).otherwise(F.col(c)))
    return x.agg(F.round(F.sum(F.col("w") * F.col("precision")), 9).alias("precision"), F.round(part("lo"), 9).alias("lo"), F.round(part("hi"), 9).alias("hi"))
