"""Row flags, constraints, depth of record and the many-measure aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import year_of


class ConstraintError(ValueError):
    """A table breaks a rule it must keep."""


def require_none(bad: DataFrame, rule: str, show: int = 5) -> None:
    """Raise if there is any row; only a few of them are fetched to name them."""
    some = bad.limit(show).collect()
    if some:
        raise ConstraintError(f"{rule}: {[tuple(r) for r in some]}")


def year_flags(year: Column, title: Column, now: int) -> Column:
    """Y0 no year, Y1 outside 1900 to now + 2, Y2 the year is part of a period named in the title."""
    y = year_of(year)
    period = F.array_contains(F.regexp_extract_all(title, F.lit(r"((?:19|20)\d{2})\s*[-–~]\s*(?:19|20)?\d{2}"), F.lit(1)), y.cast("string")) | F.array_contains(F.regexp_extract_all(title, F.lit(r"(?:19|20)\d{2}\s*[-–~]\s*((?:19|20)\d{2})"), F.lit(1)), y.cast("string"))
    return F.array_compact(F.array(F.when(y.isNull(), "Y0"), F.when(~y.between(1900, now + 2), "Y1"), F.when(F.coalesce(period, F.lit(False)), "Y2")))


def depth(levels: list[tuple[int, Column]]) -> Column:
    """Highest level whose condition holds; levels are given from the highest down. Null if none does."""
    out = F.lit(None).cast("int")
    for n, cond in reversed(levels):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(n)).otherwise(out)
    return out


def only_value(c: Column) -> Column:
    """The single distinct value of an array, null for none or several."""
    d = F.array_distinct(F.filter(c, lambda x: x.isNotNull()))
    return F.when(F.size(d) == 1, F.get(d, 0))


def first_evidence(df: DataFrame, entity: str, year: str, row_id: str) -> DataFrame:
    """(entity, year, row_id): the earliest dated row, ties to the smallest id."""
    g = df.filter(F.col(year).isNotNull()).groupBy(entity).agg(F.min(F.struct(F.col(year).alias("y"), F.col(row_id).alias("r"))).alias("m"))
    return g.select(entity, F.col("m.y").alias(year), F.col("m.r").alias(row_id))


def tags_with_rows(df: DataFrame, entity: str, row_id: str, text: Column, patterns: list[tuple[str, str]], least: int = 2) -> DataFrame:
    """(entity, tag, rows, first_row): tags whose pattern at least ``least`` rows of the entity match."""
    tags = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns]))
    x = df.select(F.col(entity), F.col(row_id).alias("r"), F.explode(tags).alias("tag"))
    return x.groupBy(entity, "tag").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("first_row")).filter(F.col("rows") >= least)


def measures(rows: DataFrame, entity: str, kinds: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """(entity, n, share_*, n_*): shares of the rows that meet each condition and distinct counts, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.round(F.count_if(F.coalesce(c, F.lit(False))) / F.count(F.lit(1)), 9).alias(f"share_{k}") for k, c in kinds.items()]
    aggs += [F.countDistinct(c).alias(f"n_{k}") for k, c in distinct.items()]
    return rows.groupBy(entity).agg(*aggs)


def listed(c: Column, most: int) -> Column:
    """Sorted distinct ids as a cell of at most ``most``, with the number left out as ``|+N``."""
    s = F.array_sort(F.array_distinct(c))
    return F.concat(F.array_join(F.slice(s, 1, most), "|"), F.when(F.size(s) > most, F.concat(F.lit("|+"), (F.size(s) - most).cast("string"))).otherwise(F.lit("")))


def capped_lists(df: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """(group, ids): ``listed`` for the distinct items of each group, without gathering a group.

    The items are ranked with a constant limit, which is cut per task before the
    shuffle, and counted beside. Null groups and items are left out.
    """
    d = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item).distinct()
    few = d.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(item))).filter(F.col("__r") <= most)
    n = d.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    ids = few.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), "|").alias("__ids"))
    rest = F.col("__n") - most
    return ids.join(n, group).select(group, F.concat("__ids", F.when(rest > 0, F.concat(F.lit("|+"), rest.cast("string"))).otherwise("")).alias("ids"))


def missing_words(rows: DataFrame, texts: DataFrame, row_id: str, entity: str, phrase: str, text: str) -> DataFrame:
    """(row_id, words, missing): rows with words that no text of the same entity holds.

    Texts become distinct (entity, word) pairs before they meet the rows, so the
    join is linear in both sides however many rows and texts an entity has.
    Entities without a text are left out.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda x: x != ""))
    held = texts.select(F.col(entity).alias("e"), F.explode(words(F.col(text))).alias("word")).distinct()
    known = held.select("e").distinct()
    asked = rows.select(F.col(row_id), F.col(entity).alias("e"), words(F.col(phrase)).alias("w")).join(known, "e", "left_semi").select(row_id, "e", F.explode("w").alias("word"))
    j = asked.join(held.withColumn("held", F.lit(True)), ["e", "word"], "left")
    return j.groupBy(row_id).agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("held").isNull()).alias("missing")).filter("missing > 0")
