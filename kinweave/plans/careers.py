"""Cohort, window, transition and quantile queries over dated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import code_family, code_year, generation_of
from ..functions.stats import wilson
from ..operators import cohorts as ch
from ..sources.tables import table as t
from .registry import query
from .ties import KEPT, kept_activities

NOW = 2026
ENTRIES = "entries AS (SELECT ledger_id, regexp_replace(frame_code, '-[0-9]{4}$', '') AS programme, TRY_CAST(NULLIF(regexp_extract(frame_code, '-([0-9]{4})$', 1), '') AS INTEGER) AS year FROM frame_membership)"


def entries(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "frame_membership").select("ledger_id", code_family(F.col("frame_code")).alias("programme"), code_year(F.col("frame_code")).alias("year"))


@query("cohort_bins", f"WITH {KEPT}, f AS (SELECT ledger_id, min(year) AS y FROM kept WHERE ledger_id IS NOT NULL GROUP BY 1) SELECT CAST(2000 + 5 * floor((y - 2000) / 5.0) AS INTEGER) AS generation, count(*) AS people FROM f GROUP BY 1")
def cohort_bins(s: SparkSession, d: str) -> DataFrame:
    f = ch.first_years(kept_activities(s, d).filter("ledger_id IS NOT NULL"), "ledger_id", "year")
    return f.groupBy(generation_of(F.col("first_year")).alias("generation")).agg(F.count(F.lit(1)).alias("people"))


@query("age_bands", f"WITH {KEPT}, f AS (SELECT ledger_id, min(year) AS y FROM kept GROUP BY 1), a AS (SELECT k.ledger_id, k.year - f.y AS age FROM kept k JOIN f USING (ledger_id)) SELECT CASE WHEN age >= 21 THEN '21+' WHEN age >= 11 THEN '11-20' WHEN age >= 6 THEN '6-10' WHEN age >= 3 THEN '3-5' ELSE '0-2' END AS band, count(*) AS rows, count(DISTINCT ledger_id) AS entities FROM a GROUP BY 1")
def age_bands(s: SparkSession, d: str) -> DataFrame:
    return ch.bands(kept_activities(s, d), "ledger_id", "year")


@query("age_grid", f"""WITH {KEPT}, f AS (SELECT ledger_id, min(year) AS y FROM kept GROUP BY 1), ages AS (SELECT * FROM (VALUES (0), (2), (5), (10)) v(age))
SELECT k.ledger_id, g.age, round(CAST(count(*) FILTER (activity_type = 'solo_exhibition') AS DOUBLE) / count(*), 9) AS value FROM kept k JOIN f USING (ledger_id) JOIN ages g ON k.year - f.y <= g.age AND f.y + g.age <= {NOW} GROUP BY 1, 2""")
def age_grid(s: SparkSession, d: str) -> DataFrame:
    solo = F.round(F.count_if(F.col("activity_type") == "solo_exhibition") / F.count(F.lit(1)), 9)
    return ch.age_grid(kept_activities(s, d), "ledger_id", "year", solo, [0, 2, 5, 10], NOW)


@query("reference_quantiles", f"""WITH {KEPT}, n AS (SELECT ledger_id, activity_type, count(*) AS c FROM kept WHERE activity_type IS NOT NULL GROUP BY 1, 2),
q AS (SELECT activity_type, count(*) AS n, percentile_disc(0.25) WITHIN GROUP (ORDER BY c) AS a, percentile_disc(0.5) WITHIN GROUP (ORDER BY c) AS b, percentile_disc(0.9) WITHIN GROUP (ORDER BY c) AS e FROM n GROUP BY 1)
SELECT activity_type, n, 0.25 AS q, CASE WHEN n * 0.25 + 1e-9 >= 10 THEN a END AS value FROM q UNION ALL SELECT activity_type, n, 0.5, CASE WHEN n * 0.5 + 1e-9 >= 10 THEN b END FROM q UNION ALL SELECT activity_type, n, 0.9, CASE WHEN n * (1 - 0.9) + 1e-9 >= 10 THEN e END FROM q""")
def reference_quantiles(s: SparkSession, d: str) -> DataFrame:
    n = kept_activities(s, d).filter("activity_type IS NOT NULL").groupBy("ledger_id", "activity_type").agg(F.count(F.lit(1)).alias("c"))
    return ch.quantiles(n, ["activity_type"], "c", [0.25, 0.5, 0.9])


@query("weighted_quantiles", """WITH v AS (SELECT o_orderpriority, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS v, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY o_orderpriority ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY o_orderpriority) AS t FROM v), q AS (SELECT * FROM (VALUES (0.25), (0.5), (0.75)) x(q))
SELECT o_orderpriority, CAST(q.q AS DOUBLE) AS q, CAST(min(v) AS INTEGER) AS value FROM c, q WHERE c >= q.q * t - 1e-9 GROUP BY 1, 2""")
def weighted_quantiles(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").select("o_orderpriority", F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01"))).alias("day"), F.lit(1.0).alias("w"))
    return ch.weighted_quantiles(o, ["o_orderpriority"], "day", "w", [0.25, 0.5, 0.75])


@query("dominant_value", f"""WITH {KEPT}, n AS (SELECT venue, activity_type, count(*) AS n FROM kept WHERE venue IS NOT NULL AND activity_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY venue) AS t, row_number() OVER (PARTITION BY venue ORDER BY n DESC, activity_type) AS k FROM n)
SELECT venue, CASE WHEN CAST(n AS DOUBLE) / t >= 0.9 THEN activity_type END AS activity_type, round(CAST(n AS DOUBLE) / t, 9) AS share FROM r WHERE k = 1""")
def dominant_value(s: SparkSession, d: str) -> DataFrame:
    return ch.dominant(kept_activities(s, d).filter("venue IS NOT NULL AND activity_type IS NOT NULL"), ["venue"], "activity_type")


@query("unique_top", f"""WITH {KEPT}, n AS (SELECT ledger_id, activity_type, count(*) AS n FROM kept WHERE ledger_id IS NOT NULL AND activity_type IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY ledger_id) AS top FROM n)
SELECT ledger_id, CASE WHEN count(*) = 1 THEN min(activity_type) END AS activity_type FROM m WHERE n = top GROUP BY 1""")
def unique_top(s: SparkSession, d: str) -> DataFrame:
    return ch.unique_top(kept_activities(s, d).filter("ledger_id IS NOT NULL AND activity_type IS NOT NULL"), ["ledger_id"], "activity_type")


MIX = "count(*) FILTER (activity_type IN ('solo_exhibition', 'group_exhibition')) AS ex, count(*) FILTER (activity_type IN ('performance', 'screening')) AS st, count(*) FILTER (activity_type IN ('award', 'residency')) AS aw"


@query("mix_bucket", f"""WITH {KEPT}, n AS (SELECT ledger_id, count(*) AS n, {MIX} FROM kept WHERE ledger_id IS NOT NULL GROUP BY 1), z AS (SELECT *, greatest(ex, st, aw) AS b FROM n)
SELECT ledger_id, CASE WHEN b * 2 >= n AND ex = b THEN 'exhibition' WHEN b * 2 >= n AND st = b THEN 'stage' WHEN b * 2 >= n AND aw = b THEN 'support' ELSE 'mixed' END AS mix FROM z""")
def mix_bucket(s: SparkSession, d: str) -> DataFrame:
    kind = lambda *xs: F.count_if(F.col("activity_type").isin(*xs)) / F.count(F.lit(1))
    n = kept_activities(s, d).filter("ledger_id IS NOT NULL").groupBy("ledger_id").agg(F.count(F.lit(1)).alias("n"), kind("solo_exhibition", "group_exhibition").alias("ex"), kind("performance", "screening").alias("st"), kind("award", "residency").alias("aw"))
    return n.select("ledger_id", ch.mix_bucket({"exhibition": F.col("ex"), "stage": F.col("st"), "support": F.col("aw")}, F.col("n")).alias("mix"))


@query("kind_shares", f"WITH {KEPT} SELECT ledger_id, activity_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY ledger_id), 9) AS share FROM kept WHERE ledger_id IS NOT NULL GROUP BY 1, 2")
def kind_shares(s: SparkSession, d: str) -> DataFrame:
    n = kept_activities(s, d).filter("ledger_id IS NOT NULL").groupBy("ledger_id", "activity_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("ledger_id").agg(F.sum("n").alias("all"))
    return n.join(total, "ledger_id").select("ledger_id", "activity_type", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


WIN = f"""WITH {KEPT}, f AS (SELECT ledger_id, min(year) AS y FROM kept WHERE ledger_id IS NOT NULL GROUP BY 1), s AS (SELECT * FROM (VALUES (0), (3), (6)) v(s)),
p AS (SELECT k.ledger_id, f.y, s.s, bool_or(k.year - f.y <= s.s) AS seen, coalesce(bool_or(k.year - f.y > s.s AND k.year - f.y <= s.s + 3 AND k.activity_type = 'solo_exhibition'), false) AS hit FROM kept k JOIN f USING (ledger_id), s GROUP BY 1, 2, 3),
g AS (SELECT s AS band_start, CAST(count(*) FILTER (y + s + 3 <= {NOW}) AS DOUBLE) AS n, count(*) FILTER (y + s + 3 > {NOW}) AS censored, count(*) FILTER (y + s + 3 <= {NOW} AND hit) AS hits FROM p WHERE seen GROUP BY 1),
w AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM g)
SELECT band_start, CASE WHEN n >= 10 THEN CAST(n AS BIGINT) END AS n, censored, CASE WHEN n >= 20 THEN round(p, 9) END AS share, CASE WHEN n >= 20 THEN round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) END AS lo,
CASE WHEN n >= 20 THEN round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) END AS hi, CASE WHEN n < 10 THEN 'suppressed' WHEN n < 20 THEN 'count_only' ELSE 'published' END AS status FROM w"""


@query("next_window_rates", WIN)
def next_window_rates(s: SparkSession, d: str) -> DataFrame:
    return ch.next_window(kept_activities(s, d).filter("ledger_id IS NOT NULL"), "ledger_id", "year", F.col("activity_type") == "solo_exhibition", [0, 3, 6], NOW)


@query("transitions", f"""WITH {ENTRIES}, f AS (SELECT ledger_id AS e, programme AS p, min(year) AS y FROM entries WHERE year IS NOT NULL AND programme IS NOT NULL AND ledger_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT p AS source, count(*) AS at_risk FROM f WHERE y <= {NOW - 1} GROUP BY 1), m AS (SELECT x.p AS source, y.p AS target, count(*) AS movers, quantile_cont(y.y - x.y, 0.5) AS median_gap FROM f x JOIN f y ON x.e = y.e AND y.y > x.y AND x.p <> y.p GROUP BY 1, 2), t AS (SELECT DISTINCT p AS target FROM f)
SELECT r.source, t.target, r.at_risk, coalesce(m.movers, 0) AS movers, CAST(m.median_gap AS DOUBLE) AS median_gap FROM r JOIN t ON r.source <> t.target LEFT JOIN m ON m.source = r.source AND m.target = t.target""")
def transitions(s: SparkSession, d: str) -> DataFrame:
    return ch.transitions(entries(s, d), "ledger_id", "programme", "year", NOW)


@query("first_timers", f"WITH {ENTRIES}, f AS (SELECT programme, ledger_id, min(year) AS y FROM entries WHERE year IS NOT NULL GROUP BY 1, 2) SELECT programme, y AS year, count(*) AS entrants FROM f GROUP BY 1, 2")
def first_timers(s: SparkSession, d: str) -> DataFrame:
    return ch.first_timers(entries(s, d), "ledger_id", "programme", "year")


@query("entry_profile", f"""WITH {KEPT}, {ENTRIES}, f AS (SELECT programme, ledger_id, min(year) AS y FROM entries WHERE year IS NOT NULL AND ledger_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT f.programme, f.ledger_id, count(k.activity_id) AS before FROM f LEFT JOIN kept k ON k.ledger_id = f.ledger_id AND k.year < f.y GROUP BY 1, 2)
SELECT programme, count(*) AS people, percentile_disc(0.5) WITHIN GROUP (ORDER BY before) AS median_before, count(*) FILTER (before = 0) AS newcomers FROM n GROUP BY 1""")
def entry_profile(s: SparkSession, d: str) -> DataFrame:
    f = entries(s, d).filter("year IS NOT NULL AND ledger_id IS NOT NULL").groupBy("programme", "ledger_id").agg(F.min("year").alias("y"))
    k = kept_activities(s, d).groupBy("ledger_id", "year").agg(F.count(F.lit(1)).alias("c"))
    n = f.join(k, "ledger_id", "left").groupBy("programme", "ledger_id").agg(F.coalesce(F.sum(F.when(F.col("year") < F.col("y"), F.col("c"))), F.lit(0)).alias("before"))
    return n.groupBy("programme").agg(F.count(F.lit(1)).alias("people"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY before)").cast("long").alias("median_before"), F.count_if(F.col("before") == 0).alias("newcomers"))


@query("programme_profile", f"""WITH {ENTRIES}, e AS (SELECT programme, year, count(DISTINCT ledger_id) AS n FROM entries WHERE year IS NOT NULL GROUP BY 1, 2), p AS (SELECT programme, ledger_id, count(DISTINCT year) AS k FROM entries WHERE year IS NOT NULL AND ledger_id IS NOT NULL GROUP BY 1, 2)
SELECT e.programme, min(e.year) AS first_year, max(e.year) AS last_year, count(*) AS editions, max(e.n) AS largest, max(r.people) AS people, max(r.returners) AS returners FROM e JOIN (SELECT programme, count(*) AS people, count(*) FILTER (k > 1) AS returners FROM p GROUP BY 1) r ON r.programme = e.programme GROUP BY 1""")
def programme_profile(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).filter("year IS NOT NULL")
    ed = e.groupBy("programme", "year").agg(F.countDistinct("ledger_id").alias("n")).groupBy("programme").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("editions"), F.max("n").alias("largest"))
    p = e.filter("ledger_id IS NOT NULL").groupBy("programme", "ledger_id").agg(F.countDistinct("year").alias("k")).groupBy("programme").agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("k") > 1).alias("returners"))
    return ed.join(p, "programme")


@query("edition_sizes", """SELECT regexp_replace(frame_code, '-[0-9]{4}$', '') AS programme, CASE WHEN grouping(frame_code) = 1 THEN '(all)' ELSE frame_code END AS edition, count(DISTINCT ledger_id) AS members FROM (SELECT frame_code, ledger_id, regexp_replace(frame_code, '-[0-9]{4}$', '') AS p FROM frame_membership WHERE frame_code IS NOT NULL) GROUP BY GROUPING SETS ((regexp_replace(frame_code, '-[0-9]{4}$', ''), frame_code), (regexp_replace(frame_code, '-[0-9]{4}$', '')))""")
def edition_sizes(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "frame_membership").filter("frame_code IS NOT NULL").select("frame_code", "ledger_id", code_family(F.col("frame_code")).alias("programme"))
    got = m.groupingSets([[F.col("programme"), F.col("frame_code")], [F.col("programme")]], F.col("programme"), F.col("frame_code")).agg(F.grouping("frame_code").alias("g"), F.countDistinct("ledger_id").alias("members"))
    return got.select("programme", F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col("frame_code")).alias("edition"), "members")


@query("trend_means", f"""WITH {KEPT}, f AS (SELECT ledger_id, min(year) AS y FROM kept WHERE ledger_id IS NOT NULL GROUP BY 1), n AS (SELECT k.ledger_id, f.y, count(DISTINCT k.venue) AS v FROM kept k JOIN f USING (ledger_id) WHERE k.year - f.y <= 5 AND f.y + 5 <= {NOW} GROUP BY 1, 2)
SELECT CAST(2000 + 5 * floor((y - 2000) / 5.0) AS INTEGER) AS generation, count(*) AS n, round(avg(v / 6.0), 9) AS venues_per_year FROM n GROUP BY 1""")
def trend_means(s: SparkSession, d: str) -> DataFrame:
    a = ch.aged(kept_activities(s, d).filter("ledger_id IS NOT NULL"), "ledger_id", "year").filter((F.col("age") <= 5) & (F.col("first_year") + 5 <= NOW))
    n = a.groupBy("ledger_id", "first_year").agg(F.countDistinct("venue").alias("v"))
    return n.groupBy(generation_of(F.col("first_year")).alias("generation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("v") / F.lit(6.0)), 9).alias("venues_per_year"))


HOLD = "SELECT c_mktsegment, n_name, CAST(avg(o_totalprice) AS DOUBLE) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate {} TIMESTAMP '1998-01-01' GROUP BY 1, 2"


@query("holdout_compare", f"WITH p AS ({HOLD.format('<')}), o AS ({HOLD.format('>=')}) SELECT count(*) FILTER (p.v IS NOT NULL AND o.v IS NOT NULL) AS \"both\", count(*) FILTER (o.v IS NULL) AS only_predicted, count(*) FILTER (p.v IS NULL) AS only_realised, round(avg(abs(p.v - o.v)), 6) AS mae, round(quantile_cont(abs(p.v - o.v), 0.5), 6) AS median_gap FROM p FULL JOIN o USING (c_mktsegment, n_name)")
def holdout_compare(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    half = lambda c: j.filter(c).groupBy("c_mktsegment", "n_name").agg(F.avg("o_totalprice").alias("v"))
    split = F.lit("1998-01-01").cast("timestamp")
    got = ch.compare(half(F.col("o_orderdate") < split), half(F.col("o_orderdate") >= split), ["c_mktsegment", "n_name"], "v")
    return got.select("both", "only_predicted", "only_realised", F.round("mae", 6).alias("mae"), F.round("median_gap", 6).alias("median_gap"))


@query("wilson_by_group", """WITH g AS (SELECT region, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (verification = 'VERIFIED') AS h FROM artists GROUP BY 1), w AS (SELECT *, h / n AS p, 1.959963984540054 AS z FROM g)
SELECT region, CAST(n AS BIGINT) AS n, h AS hits, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS lo, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS hi FROM w""")
def wilson_by_group(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "artists").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verification") == "VERIFIED").alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return g.select("region", "n", "hits", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))
