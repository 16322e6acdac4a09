"""Names in cells resolved to bodies: keys, guarded merging, election of names, places by vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .joins import hot_keys, skew_left_join


def guarded_components(edges: DataFrame, src: str, dst: str, labels: DataFrame, key: str, label: str, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """(merged, blocked): components of at most ``most`` distinct labels, and the members of those with more.

    A component that carries two readings is ambiguous, so none of its edges counts.
    """
    comp = components(edges, src, dst)
    named = comp.join(labels.select(F.col(key).alias("id"), F.col(label).alias("l")), "id", "left")
    bad = named.groupBy("root").agg(F.countDistinct("l").alias("n")).filter(F.col("n") > most).select("root")
    return comp.join(bad, "root", "left_anti").select("id", "root"), comp.join(bad, "root", "left_semi").select("id", "root")


def supported_pairs(df: DataFrame, a: Column, b: Column, entity: str, least: int = 2) -> DataFrame:
    """(a, b, support): unordered pairs of names that at least ``least`` entities wrote together."""
    p = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(entity).alias("e")).filter((F.col("a") != "") & (F.col("a") != F.col("b")))
    return p.groupBy("a", "b").agg(F.countDistinct("e").alias("support")).filter(F.col("support") >= least)


def elected_names(df: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, rows, spellings): the most frequent spelling of each group; ties to the longer, then the smaller."""
    n = df.groupBy(F.col(group).alias("__g"), F.col(name).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = n.groupBy("__g").agg(F.min_by("__v", F.struct(-F.col("__n"), -F.length("__v"), F.col("__v"))).alias("__b"), F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("spellings"))
    return best.select(F.col("__g").alias(group), F.col("__b").alias(name), "rows", "spellings")


def majority(df: DataFrame, group: str, vote: str, least: float = 0.5, votes: int = 1) -> DataFrame:
    """(group, vote): the vote of at least ``least`` of all rows of the group, with ``votes`` or more votes; ties to the smaller."""
    n = df.groupBy(F.col(group).alias("__g"), F.col(vote).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    voted = F.col("__v").isNotNull()
    best = n.groupBy("__g").agg(F.sum("__n").alias("__all"), F.min_by("__v", F.when(voted, F.struct(-F.col("__n"), F.col("__v")))).alias("__b"), F.max(F.when(voted, F.col("__n"))).alias("__top"))
    return best.filter((F.col("__top") >= F.col("__all") * least) & (F.col("__top") >= votes)).select(F.col("__g").alias(group), F.col("__b").alias(vote))


def unanimous(df: DataFrame, group: str, vote: str, votes: int = 10) -> DataFrame:
    """(group, vote): groups whose rows with a vote all agree, with at least ``votes`` of them."""
    g = df.filter(F.col(vote).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.countDistinct(vote).alias("__k"), F.count(F.lit(1)).alias("__n"), F.min(vote).alias("__v"))
    return g.filter((F.col("__k") == 1) & (F.col("__n") >= votes)).select(F.col("__g").alias(group), F.col("__v").alias(vote))


def numbered(entities: DataFrame, order: list[Column], key: str, prefix: str, width: int = 6) -> DataFrame:
    """(key, number): dense numbers in a total order, offset per range partition, so no task sees all rows."""
    ordered = entities.orderBy(*order).withColumn("__p", F.spark_partition_id())
    before = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = ordered.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    n = (F.col("b") + F.col("__r")).cast("string")
    return local.join(F.broadcast(before.select("__p", "b")), "__p").select(key, F.concat(F.lit(prefix), F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0"))).alias("number"))


def placed(df: DataFrame, row_id: str, parts: Column, places: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """(row_id, *keep): the first part of each row that names a listed place exactly, letters only.

    ``places`` may repeat a name; its most populous entry counts. A hot part is
    joined through a bounded broadcast.
    """
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    ref = places.groupBy(letters(F.col(name)).alias("k")).agg(F.max_by(F.struct(*keep), F.struct(F.coalesce("population", F.lit(0)), *keep)).alias("p")).filter("k <> ''")
    x = df.select(F.col(row_id).alias("i"), F.posexplode(parts).alias("pos", "part")).select("i", "pos", letters(F.col("part")).alias("k")).filter("k <> ''")
    hit = skew_left_join(x, ref, "k", hot_keys(x, "k"), "inner")
    best = hit.groupBy("i").agg(F.min_by("p", "pos").alias("p"))
    return best.select(F.col("i").alias(row_id), *[F.col(f"p.{c}").alias(c) for c in keep])
