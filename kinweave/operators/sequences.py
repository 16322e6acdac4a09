"""Order-dependent operators: runs, boundaries, ordinals, band joins, longest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import hub_join


def runs(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """(*part, value, start, length): maximal runs of equal neighbours (gaps and islands)."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*part, "__run").agg(F.first(value).alias(value), F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("length")).drop("__run")


def boundaries(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """(key, following): neighbours in a total order, the last one joined to the first.

    ``df`` is a small dimension: the order is total, so one task sorts it.
    """
    w = Window.orderBy(*order)
    return df.select(F.col(key), F.coalesce(F.lead(key).over(w), F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only k rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], lv: str, rv: str, width: int) -> DataFrame:
    """Rows with equal keys and values at most ``width`` apart, as an equi-join on buckets.

    Every right row is copied to the three buckets it can meet, so no task holds
    all rows of a key.
    """
    size = max(width, 1)
    a = left.withColumn("__b", F.floor(F.col(lv) / size))
    b = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col(rv) / size) + i for i in (-1, 0, 1)])))
    return a.join(b, [*keys, "__b"]).filter(F.abs(F.col(lv) - F.col(rv)) <= width).drop("__b")


def longest_prefix(df: DataFrame, code: str, prefixes: DataFrame, prefix: str, longest: int) -> DataFrame:
    """Each row with the longest listed prefix of its code, or null.

    The code is exploded to its prefixes and equi-joined, which needs no theta
    join; ``longest`` bounds the length of a listed prefix.
    """
    cut = F.sequence(F.lit(1), F.greatest(F.least(F.length(code), F.lit(longest)), F.lit(1)))
    codes = df.select(code).filter(F.length(code) > 0).distinct()
    tried = codes.select(code, F.explode(F.transform(cut, lambda i: F.substring(F.col(code), F.lit(1), i))).alias("__p"))
    best = tried.join(prefixes.select(F.col(prefix).alias("__p")).distinct(), "__p").groupBy(code).agg(F.max_by("__p", F.length("__p")).alias("matched"))
    return hub_join(df, best, code)


def first_pattern(text: Column, patterns: list[tuple[str, str]], otherwise: str = "") -> Column:
    """Name of the first pattern found in the text."""
    out = F.lit(otherwise)
    for name, pat in reversed(patterns):
        out = F.when(text.rlike(pat), F.lit(name)).otherwise(out)
    return out


def restating(rows: DataFrame, own: DataFrame, entity: str, year: str, text: Column, needle: Column) -> DataFrame:
    """Rows without those that restate an edition the entity already has in that year.

    ``own`` has one row per (entity, year, needle); the text must hold the needle.
    """
    o = own.select(F.col(entity).alias("__e"), F.col(year).alias("__y"), needle.alias("__n")).distinct()
    r = rows.withColumn("__t", text)
    cond = (F.col(entity) == F.col("__e")) & (F.col(year) == F.col("__y")) & F.contains(F.col("__t"), F.col("__n"))
    return r.join(o, cond, "left_anti").drop("__t")
