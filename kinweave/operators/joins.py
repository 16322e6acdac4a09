"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so at most 1/HOT_SHARE keys are.
HOT_SHARE = 1 / 1000
#: Rows of one key any task can hold, however few there are in all.
MANY = 10_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, total: int | None = None) -> DataFrame:
    """Keys with at least ``share`` of the rows: at most ``1/share`` rows, so safe to broadcast.

    Counts are combined on the map side; only one row per key and map task is
    shuffled. With ``total`` known, ``df`` is scanned once.
    """
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    if total is not None:
        return n.filter(F.col("__n") >= max(2, total * share)).select(key)
    every = df.agg(F.count(F.lit(1)).alias("__all"))
    return n.crossJoin(F.broadcast(every)).filter(F.col("__n") >= F.greatest(F.lit(2), F.col("__all") * share)).select(key)


def skew_left_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """Join ``big`` to ``small`` (one row per key) without sending a hot key to one task.

    Rows of hot keys meet their few matches through a broadcast of bounded size
    (one row per hot key); the rest is an ordinary shuffled join. Null keys match
    nothing and are kept by a left join.
    """
    cols = [c for c in small.columns if c != key]
    few = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    marked = big.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot"))), key, "left")
    warm = marked.filter(F.col("__hot")).drop("__hot").join(few, key, how)
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(small, key, how)
    return warm.select(*big.columns, *cols).unionByName(cold.select(*big.columns, *cols))


def hub_join(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``skew_left_join`` with the hot keys of ``big``."""
    return skew_left_join(big, small, key, hot_keys(big, key), how)


def hot_values(written: DataFrame, key: str, total: int, share: float = HOT_SHARE) -> list:
    """As ``hot_keys`` for a written table of known size, as at most ``1/share`` values."""
    n = written.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return [r[0] for r in n.filter(F.col("__n") >= max(2, total * share, MANY)).select(key).collect()]


def balanced_join(written: DataFrame, small: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """``skew_left_join`` of a written table of known size: an ordinary join where no key is hot.

    Null keys match nothing and are kept by a left join.
    """
    hot = hot_values(written, key, total)
    if not hot:
        return written.join(small, key, how).select(*written.columns, *[c for c in small.columns if c != key])
    cols = [c for c in small.columns if c != key]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = written.filter(is_hot).join(F.broadcast(small.filter(F.col(key).isin(hot))), key, how)
    cold = written.filter(~is_hot).join(small, key, how)
    return warm.select(*written.columns, *cols).unionByName(cold.select(*written.columns, *cols))
