"""Merging new rows into a table: fills, tiers, versions, and ids that are never reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(old: Column, new: Column) -> Column:
    """The old value wins unless it is null or empty."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Idempotent merge: known keys get their empty columns filled, unknown keys are added.

    ``new`` may repeat a key; its smallest non-empty value per column counts. A
    null in a key matches nothing and is added as it is.
    """
    fresh = new.groupBy(*keys).agg(*[F.min(F.nullif(F.col(c), F.lit(""))).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    both = table.withColumn("__old", F.lit(True)).join(fresh, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("__old"), filled(F.col(c), F.col(f"__{c}"))).otherwise(F.col(f"__{c}")).alias(c) for c in columns], F.when(F.col("__old").isNull(), "added").when(F.col("__new"), "matched").otherwise("kept").alias("how"))


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the table lacks, one per key."""
    return new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def tiered_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, list[str]]]) -> DataFrame:
    """(left_id, right_id, tier): for each left row, the match of the first tier that has one.

    A tier is (name, equal columns). Ties inside a tier go to the smallest right id.
    """
    out = None
    for k, (name, cols) in enumerate(tiers):
        best = right.groupBy(*cols).agg(F.min(right_id).alias("__r"))
        hit = left.select(left_id, *cols).join(best, cols).select(left_id, F.struct(F.lit(k).alias("k"), F.lit(name).alias("tier"), F.col("__r").alias("r")).alias("m"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy(left_id).agg(F.min("m").alias("m")).select(left_id, F.col("m.r").alias(right_id), F.col("m.tier").alias("tier"))


def latest(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; one map-side combined aggregation, no window."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def first_wins(df: DataFrame, keys: list[Column], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per derived key, the first by ``order``, with the number of rows it stands for."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    best = df.groupBy(key.alias("k")).agg(F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("b"), F.count(F.lit(1)).alias("rows"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in columns], "rows")


def mutual_unique(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """(left_id, right_id): pairs of which each side has the other as its only partner on ``keys``.

    A key with several rows on a side cannot give a mutual pair, so both sides are
    counted per key before they meet; no many-to-many join arises.
    """
    one = lambda df, i: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(i).alias(i)).filter("n = 1").drop("n")
    return one(left, left_id).join(one(right, right_id), keys).select(left_id, right_id)


def allocate_ids(df: DataFrame, existing: DataFrame, number: str, order: list[str], prefix: str, width: int = 6) -> DataFrame:
    """Numbers after the highest ever issued, in ``order``: (*columns, new_id).

    A global running number without one big partition: rows are range-sorted,
    counted per partition, and offset by the counts before.
    """
    highest = existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    ordered = df.orderBy(*order).withColumn("__p", F.spark_partition_id())
    counts = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    local = ordered.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    joined = local.join(F.broadcast(before), "__p").crossJoin(F.broadcast(highest))
    digits = (F.col("top") + F.col("before") + F.col("__r")).cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return joined.select(*df.columns, F.concat(F.lit(prefix), padded).alias("new_id"))


def missing_numbers(df: DataFrame, number: str) -> DataFrame:
    """(after, gap): runs of numbers skipped between issued ones."""
    n = df.select(F.col(number).alias("x")).distinct()
    # the next issued number of x is found by bucketed lookup, not by one global window
    w = Window.partitionBy("b").orderBy("x")
    size = 100_000
    b = n.withColumn("b", F.floor(F.col("x") / size))
    firsts = b.groupBy("b").agg(F.min("x").alias("first"))
    nxt = firsts.withColumn("next_first", F.lead("first").over(Window.orderBy("b"))).select("b", "next_first")
    led = b.withColumn("nx", F.lead("x").over(w)).join(nxt, "b", "left")
    got = led.select(F.col("x").alias("after"), (F.coalesce("nx", "next_first") - F.col("x") - 1).alias("gap"))
    return got.filter("gap > 0")
