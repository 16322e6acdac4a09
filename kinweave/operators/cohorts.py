"""Careers as dated rows: first years, ages, bands, next windows, transitions and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.dates import band_of


def first_years(rows: DataFrame, entity: str, year: str) -> DataFrame:
    return rows.filter(F.col(year).isNotNull()).groupBy(entity).agg(F.min(year).alias("first_year"))


def aged(rows: DataFrame, entity: str, year: str) -> DataFrame:
    """The rows with ``first_year`` and ``age`` of their entity."""
    return rows.filter(F.col(year).isNotNull()).join(first_years(rows, entity, year), entity).withColumn("age", F.col(year) - F.col("first_year"))


def age_grid(rows: DataFrame, entity: str, year: str, measure: Column, ages: list[int], now: int) -> DataFrame:
    """(entity, age, value): ``measure`` aggregated over the rows up to each age the entity has reached.

    An entity without rows up to an age has none (an empty window is no zero).
    """
    grid = F.explode(F.array(*map(F.lit, ages)))
    a = aged(rows, entity, year).withColumn("at", grid).filter((F.col("age") <= F.col("at")) & (F.col("first_year") + F.col("at") <= now))
    return a.groupBy(entity, F.col("at").alias("age")).agg(measure.alias("value"))


def dominant(df: DataFrame, group: list[str], value: str, least: float = 0.9) -> DataFrame:
    """(*group, value, share): the most frequent value, ties to the smallest, null where its share is below ``least``."""
    n = df.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = n.groupBy(*group).agg(F.max("__n").alias("__top"), F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias("__b"), F.sum("__n").alias("__all"))
    share = F.col("__top") / F.col("__all")
    return best.select(*group, F.when(share >= least, F.col("__b")).alias(value), F.round(share, 9).alias("share"))


def unique_top(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(*group, value): the most frequent value, null on a tie."""
    n = df.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    top = n.groupBy(*group).agg(F.max(F.struct("__n")).alias("__t"), F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias("__b"))
    ties = n.join(top, group).filter(F.col("__n") == F.col("__t.__n")).groupBy(*group).agg(F.count(F.lit(1)).alias("__k"), F.min("__b").alias("__b"))
    return ties.select(*group, F.when(F.col("__k") == 1, F.col("__b")).alias(value))


def mix_bucket(shares: dict[str, Column], n: Column) -> Column:
    """Name of the largest share of at least one half, in the given order on a tie; else mixed, none without rows."""
    best = F.greatest(*shares.values())
    out = F.lit("mixed")
    for name, s in reversed(shares.items()):
        out = F.when((s == best) & (best >= 0.5), F.lit(name)).otherwise(out)
    return F.when(n == 0, "none").otherwise(out)


def next_window(rows: DataFrame, entity: str, year: str, outcome: Column, starts: list[int], now: int, width: int = 3, k: int = 10, pct_min: int = 20) -> DataFrame:
    """Per age band: people at risk, censored, hits, share of people with the outcome in the next ``width`` years, and its Wilson bounds.

    An entity counts once per band, if it has a row up to the band's first age;
    it is censored if the window is not over yet. Shares of fewer than ``pct_min``
    people, and counts below ``k``, are withheld. One pass over the rows.
    """
    a = aged(rows.withColumn("__hit", outcome), entity, year)
    at = F.explode(F.array(*map(F.lit, starts)))
    per = a.withColumn("s", at).groupBy(entity, "first_year", "s").agg(
        F.bool_or(F.col("age") <= F.col("s")).alias("seen"), F.bool_or((F.col("age") > F.col("s")) & (F.col("age") <= F.col("s") + width) & F.coalesce("__hit", F.lit(False))).alias("hit")
    )
    seen = per.filter("seen").withColumn("open", F.col("first_year") + F.col("s") + width <= now)
    agg = seen.groupBy(F.col("s").alias("band_start")).agg(F.count_if("open").alias("n"), F.count_if(~F.col("open")).alias("censored"), F.count_if(F.col("open") & F.col("hit")).alias("hits"))
    lo, hi = stats.wilson(F.col("hits"), F.col("n"))
    shown = F.col("n") >= pct_min
    status = F.when(F.col("n") < k, "suppressed").when(~shown, "count_only").otherwise("published")
    return agg.select("band_start", F.when(F.col("n") >= k, F.col("n")).alias("n"), "censored", F.when(shown, F.round(F.col("hits") / F.col("n"), 9)).alias("share"), F.when(shown, F.round(lo, 9)).alias("lo"), F.when(shown, F.round(hi, 9)).alias("hi"), status.alias("status"))


def transitions(entries: DataFrame, entity: str, programme: str, year: str, now: int) -> DataFrame:
    """(source, target, at_risk, movers, median_gap) for all ordered pairs of programmes.

    At risk: entities whose first year in the source is before ``now``; movers
    first appear in the target later. The programmes of one entity are few and
    distinct, and pairs are formed per entity only; the frame of all programme
    pairs is one row per pair, bounded by the number of programmes squared.
    """
    first = entries.filter(F.col(year).isNotNull() & F.col(programme).isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(entity).alias("e"), F.col(programme).alias("p")).agg(F.min(year).alias("y"))
    risk = first.filter(F.col("y") <= now - 1).groupBy(F.col("p").alias("source")).agg(F.count(F.lit(1)).alias("at_risk"))
    x, y = first.alias("x"), first.alias("y")
    moved = x.join(y, F.col("x.e") == F.col("y.e")).filter((F.col("y.y") > F.col("x.y")) & (F.col("x.p") != F.col("y.p")))
    moves = moved.groupBy(F.col("x.p").alias("source"), F.col("y.p").alias("target")).agg(F.count(F.lit(1)).alias("movers"), F.percentile(F.col("y.y") - F.col("x.y"), F.lit(0.5)).alias("median_gap"))
    names = first.select(F.col("p").alias("target")).distinct()
    frame = risk.crossJoin(F.broadcast(names)).filter("source <> target")
    return frame.join(moves, ["source", "target"], "left").select("source", "target", "at_risk", F.coalesce("movers", F.lit(0)).cast("long").alias("movers"), "median_gap")


def first_timers(entries: DataFrame, entity: str, programme: str, year: str) -> DataFrame:
    """(programme, year, entrants): entities whose first year in the programme it is."""
    first = entries.filter(F.col(year).isNotNull()).groupBy(programme, entity).agg(F.min(year).alias("y"))
    return first.groupBy(programme, F.col("y").alias("year")).agg(F.count(F.lit(1)).alias("entrants"))


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """(*group, q, value): the smallest value at which the cumulated weight reaches q of the total.

    Values are pre-aggregated, so the window orders distinct values, not rows.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    w = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = v.withColumn("c", F.sum("w").over(w)).withColumn("t", F.sum("w").over(Window.partitionBy(*group)))
    return cum.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).filter(F.col("c") >= F.col("q") * F.col("t") - 1e-9).groupBy(*group, "q").agg(F.min("v").alias("value"))


def quantiles(df: DataFrame, group: list[str], value: str, qs: list[float], k: int = 10) -> DataFrame:
    """(*group, n, q, value): exact inverse-distribution quantiles, null where too few lie beyond."""
    kind = df.schema[value].dataType
    cols = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").cast(kind).alias(f"q{i}") for i, q in enumerate(qs)]
    agg = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *cols)
    rows = F.array(*[F.struct(F.lit(q).alias("q"), F.when(stats.quantile_allowed(F.col("n"), q, k), F.col(f"q{i}")).alias("v")) for i, q in enumerate(qs)])
    return agg.select(*group, "n", F.explode(rows).alias("r")).select(*group, "n", "r.q", F.col("r.v").alias("value"))


def compare(prediction: DataFrame, outcome: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row comparing two tables by key: cells in both, only left, only right, mean and median absolute difference."""
    both = prediction.select(*keys, F.col(value).alias("p")).join(outcome.select(*keys, F.col(value).alias("o")), keys, "full_outer")
    gap = F.abs(F.col("p") - F.col("o"))
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("o").isNotNull()).alias("both"), F.count_if(F.col("o").isNull()).alias("only_predicted"), F.count_if(F.col("p").isNull()).alias("only_realised"), F.round(F.avg(gap), 9).alias("mae"), F.round(F.percentile(gap, F.lit(0.5)), 9).alias("median_gap"))


def bands(rows: DataFrame, entity: str, year: str) -> DataFrame:
    """(band, rows, entities) over the ages of dated rows."""
    a = aged(rows, entity, year).withColumn("band", band_of(F.col("age")))
    return a.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"))
