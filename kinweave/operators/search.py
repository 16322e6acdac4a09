"""Serving queries: facets, shelves, scored text, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import cosine
from .joins import hub_join


def facet_filter(df: DataFrame, query: str, fields: list[str], facets: dict[str, list[str]]) -> DataFrame:
    """Rows whose joined fields contain the query and that match one value of every facet."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    cond = F.contains(hay, F.lit(query.lower()))
    for col, values in facets.items():
        cond = cond & F.col(col).isin(*values)
    return df.filter(cond)


def shelves(df: DataFrame, tags: Column, other: str = "other") -> DataFrame:
    """(shelf, n): rows per tag, rows without a tag on the shelf ``other``; a row counts once per shelf."""
    t = F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    shelf = F.explode(F.when(F.size(t) == 0, F.array(F.lit(other))).otherwise(t))
    return df.select(shelf.alias("shelf")).groupBy("shelf").agg(F.count(F.lit(1)).alias("n"))


def text_score(query: str, fields: dict[str, float]) -> Column:
    """Exact 6w, prefix 4w, contained 3w; with several words one w for each contained one."""
    q = " ".join(query.lower().split())
    words = q.split()
    score = F.lit(0.0)
    for col, w in fields.items():
        t = F.lower(F.coalesce(F.col(col), F.lit("")))
        squashed = F.contains(F.regexp_replace(t, r"\s+", ""), F.lit(q.replace(" ", "")))
        score = score + F.when(t == q, 6 * w).when(F.startswith(t, F.lit(q)), 4 * w).when(F.contains(t, F.lit(q)) | squashed, 3 * w).otherwise(0.0)
        if len(words) > 1:
            for x in words:
                score = score + F.when(F.contains(t, F.lit(x)), w).otherwise(0.0)
    return score


def scored_search(df: DataFrame, query: str, fields: dict[str, float], order: list[str], limit: int = 30) -> DataFrame:
    """The best rows by score, ties by ``order``: a top-k report, so the limit is the feature."""
    return df.withColumn("score", text_score(query, fields)).filter("score > 0").orderBy(F.desc("score"), *order).limit(limit)


def nearest(df: DataFrame, vector: str, query: list[float], order: list[str], limit: int = 8) -> DataFrame:
    """The most similar vectors to one query vector; every row is scored where it lies, k rows per task are kept."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), *order).limit(limit)


def hybrid_search(df: DataFrame, query: str, text: str, vector: str, qvec: list[float], order: list[str], limit: int = 8) -> DataFrame:
    """Substring 2.5, each contained word 0.55, cosine times 1.2; only positive scores."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = F.when(F.contains(t, F.lit(query.lower())), 2.5).otherwise(0.0)
    for w in query.lower().split():
        score = score + F.when(F.contains(t, F.lit(w)), 0.55).otherwise(0.0)
    score = score + 1.2 * cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in qvec]))
    return df.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), *order).limit(limit)


def shared_only(df: DataFrame, value: str, entity: str, least: int = 2) -> DataFrame:
    """The rows with ``value`` blanked where fewer than ``least`` entities have it."""
    many = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(entity).alias("__n")).filter(F.col("__n") >= least).select(value, F.lit(True).alias("__many"))
    return hub_join(df, many, value).withColumn(value, F.when(F.col("__many"), F.col(value))).drop("__many")
