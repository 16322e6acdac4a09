"""State that changes between runs: review items, corrections, versions, renamed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync(wanted: DataFrame, open_items: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, action): open for wanted items not open yet, close for open ones no longer wanted, keep for the rest."""
    w = wanted.select(*keys).distinct().withColumn("__w", F.lit(True))
    o = open_items.select(*keys).distinct().withColumn("__o", F.lit(True))
    j = w.join(o, keys, "full_outer")
    return j.select(*keys, F.when(F.col("__o").isNull(), "open").when(F.col("__w").isNull(), "close").otherwise("keep").alias("action"))


def corrected(df: DataFrame, keys: list[str], corrections: DataFrame, field: str, value: str, columns: list[str], order: str) -> DataFrame:
    """``df`` with the latest correction of each (key, column) over its derived value; an empty correction clears."""
    c = corrections.filter(F.col(field).isin(*columns)).groupBy(*keys, field).agg(F.max_by(value, order).alias("v"))
    wide = c.groupBy(*keys).agg(*[F.max(F.when(F.col(field) == k, F.struct(F.col("v")))).alias(f"__{k}") for k in columns])
    j = df.join(wide, keys, "left")
    return j.select(*[F.when(F.col(f"__{k}").isNotNull(), F.col(f"__{k}.v")).otherwise(F.col(k)).alias(k) if k in columns else F.col(k) for k in df.columns])


def version_rows(history: DataFrame, now: DataFrame, keys: list[str], content: list[str], stamp: Column) -> DataFrame:
    """Rows to append to a history: keys that are new or whose content differs from their last version."""
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in content])), 256)
    last = history.groupBy(*keys).agg(F.max_by(F.struct("version", "digest"), "version").alias("l"))
    j = now.select(*keys, *content, digest.alias("digest")).join(last, keys, "left")
    fresh = j.filter(~F.coalesce(F.col("l.digest") == F.col("digest"), F.lit(False)))
    return fresh.select(*keys, *content, (F.coalesce(F.col("l.version"), F.lit(0)) + 1).cast("int").alias("version"), "digest", stamp.alias("since"))


def paired_changes(old: DataFrame, new: DataFrame, keys: list[str], old_id: str, new_id: str) -> DataFrame:
    """(old_id, new_id): ids of equal keys paired in order; more old than new ones go to the last new id."""
    o = old.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(old_id)))
    n = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(new_id)))
    count = new.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__c"))
    j = o.join(count, keys).withColumn("__n", F.least("__n", "__c"))
    return j.join(n.select(*keys, "__n", new_id), [*keys, "__n"]).filter(F.col(old_id) != F.col(new_id)).select(old_id, new_id)


def stale(extractions: DataFrame, sources: DataFrame, doc: str, source: str, digest: str) -> DataFrame:
    """(doc): extractions of which a source is gone or has another content digest now."""
    s = sources.select(source, F.col(digest).alias("__now"))
    j = extractions.join(s, source, "left")
    return j.filter(~F.coalesce(F.col(digest) == F.col("__now"), F.lit(False))).select(doc).distinct()


def superseded(rows: DataFrame, keys: list[str], origin: str, better: str) -> DataFrame:
    """``rows`` with ``superseded``: another row of the key comes from the better origin and this one does not."""
    have = rows.filter(F.col(origin) == better).select(*keys).distinct().withColumn("__b", F.lit(True))
    j = rows.join(have, keys, "left")
    return j.select(*rows.columns, (F.coalesce("__b", F.lit(False)) & ~F.coalesce(F.col(origin) == better, F.lit(False))).alias("superseded"))


def without_mark(c: Column, mark: str) -> Column:
    """A ``;``-separated note without one of its marks."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != mark) & ~x.startswith(mark + "="))
    return F.array_join(parts, "; ")
