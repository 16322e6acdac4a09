"""Disclosure-controlled tables, audit samples, and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import nfc
from ..functions.split import alias_values
from ..functions.text import tokenize
from ..operators import disclosure as dc
from ..operators import sampling as sm
from ..operators import search as se
from ..operators.sequences import first_pattern
from ..sources.tables import table as t
from .registry import query

CELLS = "cells AS (SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) FILTER (c_acctbal > 8000) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"


def cells(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "customer").join(t(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("c_acctbal") > 8000).alias("n"))


@query("disclosure_primary", f"WITH {CELLS} SELECT region, segment, CASE WHEN n > 0 AND n < 10 THEN 'suppressed' ELSE CAST(5 * CAST(floor((n + 2) / 5) AS BIGINT) AS VARCHAR) END AS shown FROM cells")
def disclosure_primary(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).select("region", "segment", dc.displayed(F.col("n"), dc.primary(F.col("n"))).alias("shown"))


DOM = """d AS (SELECT region, source_type, count(*) AS n FROM artists WHERE source_type IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY region) AS t, max(n) OVER (PARTITION BY region) AS m, count(*) OVER (PARTITION BY region) AS k, CASE WHEN n < 10 THEN 'suppressed' ELSE 'published' END AS st FROM d)"""


@query("disclosure_dominance", f"WITH {DOM} SELECT region, source_type, n, CASE WHEN m >= 0.5 * t AND m >= 10 AND k > 1 AND n = m THEN 'bound' WHEN m >= 0.5 * t AND m >= 10 AND k > 1 THEN 'suppressed' ELSE st END AS status FROM w")
def disclosure_dominance(s: SparkSession, d: str) -> DataFrame:
    n = t(s, d, "artists").filter("source_type IS NOT NULL").groupBy("region", "source_type").agg(F.count(F.lit(1)).alias("n"))
    return dc.with_dominance(n.withColumn("status", dc.primary(F.col("n"))), ["region"], "n", "status", least=0.5)


@query("disclosure_full")
def disclosure_full(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).withColumn("status", dc.primary(F.col("n")))
    got = dc.secondary(c, [["region"], ["segment"]], ["region", "segment"], "n", "status")
    return got.select("region", "segment", "status", dc.displayed(F.col("n"), F.col("status")).alias("shown"))


@query("differencing_check", "WITH p AS (SELECT region, field, count(*) AS n FROM artists GROUP BY 1, 2), k AS (SELECT region, field, count(*) AS n FROM artists WHERE verification = 'VERIFIED' GROUP BY 1, 2) SELECT p.region, p.field, p.n - k.n AS exposed FROM p JOIN k USING (region, field) WHERE p.n - k.n > 0 AND p.n - k.n < 3")
def differencing_check(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "artists")
    n = lambda x: x.groupBy("region", "field").agg(F.count(F.lit(1)).alias("n"))
    return dc.differencing(n(a), n(a.filter("verification = 'VERIFIED'")), ["region", "field"], "n", 3)


@query("leak_scan")
def leak_scan(s: SparkSession, d: str) -> DataFrame:
    """Documents that print a name of a person: either script, aliases too, in either order of its parts."""
    names = F.flatten(F.array_compact(F.array(F.array("name_ko", "name_en"), alias_values(F.col("aliases")))))
    tokens = t(s, d, "artists").select(F.explode(names).alias("name")).filter("name IS NOT NULL").distinct()
    tokens = tokens.select(F.explode(dc.name_tokens(nfc(F.col("name")))).alias("token"))
    docs = t(s, d, "documents").select("doc_id", nfc(F.col("text")).alias("text"))
    return dc.name_leaks(docs, "doc_id", "text", tokens, "token")


@query("having_k_regions", "SELECT region, count(DISTINCT gy_id) AS people FROM artists GROUP BY 1 HAVING count(DISTINCT gy_id) >= 20")
def having_k_regions(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "artists").groupBy("region").agg(F.countDistinct("gy_id").alias("people")).filter("people >= 20")


@query("rounded_institutions", "SELECT venue, CAST(5 * CAST(floor((count(DISTINCT ledger_id) + 2) / 5) AS BIGINT) AS BIGINT) AS people FROM activities WHERE venue IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ledger_id) >= 10")
def rounded_institutions(s: SparkSession, d: str) -> DataFrame:
    n = t(s, d, "activities").filter("venue IS NOT NULL").groupBy("venue").agg(F.countDistinct("ledger_id").alias("n"))
    return n.filter("n >= 10").select("venue", stats.round_to_5(F.col("n")).alias("people"))


@query("home_abroad_share", "WITH r AS (SELECT region, CASE WHEN country = 'KR' THEN 'home' WHEN regexp_full_match(country, '[A-Z]{2}') THEN 'abroad' ELSE 'unresolved' END AS grp FROM artists) SELECT region, grp, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY region), 9) AS share FROM r GROUP BY 1, 2")
def home_abroad_share(s: SparkSession, d: str) -> DataFrame:
    grp = F.when(F.col("country") == "KR", "home").when(F.col("country").rlike("^[A-Z]{2}$"), "abroad").otherwise("unresolved")
    n = t(s, d, "artists").groupBy("region", grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("region").agg(F.sum("n").alias("all")), "region").select("region", "grp", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@query("coverage_pct", "WITH m AS (SELECT regexp_replace(frame_code, '-[0-9]{4}$', '') AS programme, count(DISTINCT ledger_id) AS members FROM frame_membership WHERE frame_code IS NOT NULL GROUP BY 1), z AS (SELECT count(*) AS n FROM artists) SELECT programme, members, round(100.0 * CAST(members AS DOUBLE) / greatest(n, members), 1) AS pct FROM m, z")
def coverage_pct(s: SparkSession, d: str) -> DataFrame:
    from ..functions.dates import code_family

    m = t(s, d, "frame_membership").filter("frame_code IS NOT NULL").groupBy(code_family(F.col("frame_code")).alias("programme")).agg(F.countDistinct("ledger_id").alias("members"))
    z = t(s, d, "artists").agg(F.count(F.lit(1)).alias("n"))
    return m.crossJoin(F.broadcast(z)).select("programme", "members", F.round(100.0 * F.col("members") / F.greatest("n", "members"), 1).alias("pct"))


HAM = "z AS (SELECT region, count(*) AS z FROM artists GROUP BY 1), h AS (SELECT region, z, floor(100 * z / sum(z) OVER ()) AS b, (100 * z) % sum(z) OVER () AS r FROM z), q AS (SELECT *, row_number() OVER (ORDER BY r DESC, z DESC, region) AS k, 100 - sum(b) OVER () AS rest FROM h)"


@query("hamilton_quota", f"WITH {HAM} SELECT region, CAST(b + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q")
def hamilton_quota(s: SparkSession, d: str) -> DataFrame:
    return sm.hamilton(t(s, d, "artists").groupBy("region").agg(F.count(F.lit(1)).alias("z")), "region", "z", 100)


@query("stratified_sample")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    return sm.stratified_sample(t(s, d, "artists").select("ledger_id", "region"), "region", "ledger_id", hamilton_quota(s, d), 1)


ROLL = """g AS (SELECT CASE WHEN grouping(region) = 1 THEN '(all)' ELSE region END AS stratum, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (verification = 'VERIFIED') AS hits FROM artists WHERE verification IS NOT NULL GROUP BY ROLLUP (region)), w AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM g),
sc AS (SELECT stratum, CAST(n AS BIGINT) AS n, hits, round(p, 9) AS precision, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS lo, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS hi FROM w)"""


def scores(s: SparkSession, d: str) -> DataFrame:
    return sm.label_scores(t(s, d, "artists").filter("verification IS NOT NULL").select("region", (F.col("verification") == "VERIFIED").alias("hit")), "region", "hit")


@query("wilson_rollup", f"WITH {ROLL} SELECT * FROM sc")
def wilson_rollup(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d)


@query("weighted_precision", f"WITH {ROLL}, j AS (SELECT sc.*, 2 * n AS sz, CAST(2 * n AS DOUBLE) / sum(2 * n) OVER () AS w FROM sc WHERE stratum <> '(all)') SELECT round(sum(w * precision), 9) AS precision, round(sum(w * lo), 9) AS lo, round(sum(w * hi), 9) AS hi FROM j")
def weighted_precision(s: SparkSession, d: str) -> DataFrame:
    sc = scores(s, d).filter("stratum <> '(all)'")
    return sm.weighted_precision(sc, sc.select("stratum", (F.col("n") * 2).alias("size")), "stratum", "size")


@query("facet_filter", "SELECT ledger_id FROM artists WHERE contains(lower(concat_ws(' ', coalesce(name_ko, ''), coalesce(name_en, ''), coalesce(affiliation, ''))), 'space') AND region IN ('Hansol', 'Miroe') AND field IN ('media art', 'sound')")
def facet_filter(s: SparkSession, d: str) -> DataFrame:
    return se.facet_filter(t(s, d, "artists"), "space", ["name_ko", "name_en", "affiliation"], {"region": ["Hansol", "Miroe"], "field": ["media art", "sound"]}).select("ledger_id")


@query("shelf_groups", "WITH x AS (SELECT ledger_id, unnest(CASE WHEN trim(coalesce(category, '')) = '' THEN ['other'] ELSE list_distinct(list_filter([trim(category), field], lambda x: x IS NOT NULL AND x <> '')) END) AS shelf FROM artists) SELECT shelf, count(*) AS n FROM x GROUP BY 1")
def shelf_groups(s: SparkSession, d: str) -> DataFrame:
    c = F.trim(F.coalesce("category", F.lit("")))
    return se.shelves(t(s, d, "artists"), F.when(c != "", F.array(c, F.col("field"))))


SCORE = " + ".join(f"CASE WHEN lower(coalesce({c}, '')) = 'art center' THEN {6 * w} WHEN starts_with(lower(coalesce({c}, '')), 'art center') THEN {4 * w} WHEN contains(lower(coalesce({c}, '')), 'art center') OR contains(regexp_replace(lower(coalesce({c}, '')), '\\s+', '', 'g'), 'artcenter') THEN {3 * w} ELSE 0 END + CASE WHEN contains(lower(coalesce({c}, '')), 'art') THEN {w} ELSE 0 END + CASE WHEN contains(lower(coalesce({c}, '')), 'center') THEN {w} ELSE 0 END" for c, w in (("title", 2.0), ("venue", 1.5)))


@query("scored_search", f"SELECT activity_id, CAST(score AS DOUBLE) AS score FROM (SELECT activity_id, {SCORE} AS score FROM activities) WHERE score > 0 ORDER BY score DESC, activity_id LIMIT 30")
def scored_search(s: SparkSession, d: str) -> DataFrame:
    return se.scored_search(t(s, d, "activities").select("activity_id", "title", "venue"), "Art Center", {"title": 2.0, "venue": 1.5}, ["activity_id"]).select("activity_id", "score")


def _query_vector(dim: int) -> list[float]:
    return [1.0 if i % 3 == 0 else -0.5 for i in range(dim)]


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CASE WHEN (i - 1) % 3 = 0 THEN 1.0 ELSE -0.5 END))"
NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE 0.25 END)))"


@query("cosine_topk", f"SELECT vec_id, round({DOT} / ({NORM}), 6) AS score FROM embeddings ORDER BY {DOT} / ({NORM}) DESC, vec_id LIMIT 8")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    return se.nearest(t(s, d, "embeddings").select("vec_id", "embedding"), "embedding", _query_vector(64), ["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


@query("hybrid_search", f"WITH x AS (SELECT doc_id, embedding, CASE WHEN contains(lower(coalesce(text, '')), 'velvet lens') THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), 'velvet') THEN 0.55 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), 'lens') THEN 0.55 ELSE 0 END AS tx FROM documents JOIN embeddings ON doc_id = vec_id) SELECT doc_id, round(tx + 1.2 * {DOT} / ({NORM}), 6) AS score FROM x WHERE tx + 1.2 * {DOT} / ({NORM}) > 0 ORDER BY tx + 1.2 * {DOT} / ({NORM}) DESC, doc_id LIMIT 8")
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "documents").join(t(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding")
    return se.hybrid_search(j, "velvet lens", "text", "embedding", _query_vector(64), ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@query("shared_value_mask", "WITH m AS (SELECT venue FROM activities WHERE venue IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ledger_id) >= 2) SELECT a.activity_id, m.venue FROM activities a LEFT JOIN m ON a.venue = m.venue")
def shared_value_mask(s: SparkSession, d: str) -> DataFrame:
    return se.shared_only(t(s, d, "activities").select("activity_id", "ledger_id", "venue"), "venue", "ledger_id").select("activity_id", "venue")


@query("search_tokens", """WITH t AS (SELECT lower(title) AS s FROM activities), r AS (SELECT list_distinct(list_concat(regexp_extract_all(s, '[a-z0-9]{2,}|[가-힣]{2,}'), flatten(list_transform(regexp_extract_all(s, '[가-힣]{3,}'), lambda w: list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))))) AS v FROM t) SELECT token, count(*) AS n FROM (SELECT unnest(v) AS token FROM r) GROUP BY 1""")
def search_tokens(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select(F.explode(tokenize(F.col("title"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


ROUTES = [("position", r"where|position|어디"), ("next", r"next|다음|become"), ("trend", r"trend|since|winter")]


@query("routed_questions", "SELECT item_id, CASE WHEN regexp_matches(lower(text), 'where|position|어디') THEN 'position' WHEN regexp_matches(lower(text), 'next|다음|become') THEN 'next' WHEN regexp_matches(lower(text), 'trend|since|winter') THEN 'trend' ELSE 'none' END AS route FROM eval_items")
def routed_questions(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "eval_items").select("item_id", first_pattern(F.lower("text"), ROUTES, "none").alias("route"))


TECH = [("light", "light|빛"), ("sound", "sound|소리"), ("machine", "machine|기계")]


@query("tech_first_year", "WITH y AS (SELECT ledger_id, title, TRY_CAST(NULLIF(regexp_extract(year, '(19[0-9]{2}|20[0-9]{2})', 1), '') AS INTEGER) AS y FROM activities) SELECT ledger_id, tech, min(y) AS first_year FROM (SELECT ledger_id, y, unnest(list_filter([CASE WHEN regexp_matches(lower(title), 'light|빛') THEN 'light' END, CASE WHEN regexp_matches(lower(title), 'sound|소리') THEN 'sound' END, CASE WHEN regexp_matches(lower(title), 'machine|기계') THEN 'machine' END], lambda x: x IS NOT NULL)) AS tech FROM y WHERE y IS NOT NULL) GROUP BY 1, 2")
def tech_first_year(s: SparkSession, d: str) -> DataFrame:
    from ..functions.dates import year_of

    tags = F.array_compact(F.array(*[F.when(F.lower("title").rlike(p), F.lit(n)) for n, p in TECH]))
    return t(s, d, "activities").select("ledger_id", year_of(F.col("year")).alias("y"), F.explode(tags).alias("tech")).filter("y IS NOT NULL").groupBy("ledger_id", "tech").agg(F.min("y").alias("first_year"))


GROUPS = "d AS (SELECT region, field, count(*) AS n FROM artists WHERE region IS NOT NULL AND field IS NOT NULL GROUP BY 1, 2)"


def grouped(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "artists").filter("region IS NOT NULL AND field IS NOT NULL").groupBy("region", "field").agg(F.count(F.lit(1)).alias("n"))


@query("disclosed_shares", f"WITH {GROUPS}, w AS (SELECT *, sum(n) OVER (PARTITION BY region) AS t, bool_and(n >= 10) OVER (PARTITION BY region) AS whole FROM d) SELECT region, field, CASE WHEN whole THEN CAST(CAST(floor(100 * n / t + 0.5) AS BIGINT) AS VARCHAR) ELSE 'suppressed' END AS share FROM w")
def disclosed_shares(s: SparkSession, d: str) -> DataFrame:
    """Percentages of the fields of each region, only where no field is withheld."""
    return dc.shares(grouped(s, d).withColumn("status", dc.primary(F.col("n"))), ["region"], "n", "status").select("region", "field", "share")


@query("full_group_shares", f"WITH {GROUPS}, w AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY region) AS p FROM d) SELECT region, field, CASE WHEN p >= 0.9 THEN '>=90' ELSE CAST(CAST(floor(100 * p + 0.5) AS BIGINT) AS VARCHAR) END AS share FROM w WHERE n >= 10")
def full_group_shares(s: SparkSession, d: str) -> DataFrame:
    """Percentages of the whole region, printed for fields of ten or more."""
    return dc.full_shares(grouped(s, d), ["region"], "n").filter("n >= 10").select("region", "field", "share")


@query("margins_match", "WITH a AS (SELECT region, count(*) AS l FROM artists WHERE region IS NOT NULL AND field IS NOT NULL GROUP BY 1), b AS (SELECT region, count(*) AS r FROM artists WHERE region IS NOT NULL AND category IS NOT NULL GROUP BY 1) SELECT coalesce(a.region, b.region) AS region, l AS left_sum, r AS right_sum FROM a FULL JOIN b ON a.region = b.region WHERE l IS DISTINCT FROM r")
def margins_match(s: SparkSession, d: str) -> DataFrame:
    """Regions whose people by field and by category do not add up to the same."""
    other = t(s, d, "artists").filter("region IS NOT NULL AND category IS NOT NULL").groupBy("region", "category").agg(F.count(F.lit(1)).alias("n"))
    return dc.unequal_margins(grouped(s, d), other, "n", ["region"])


@query("unsafe_cells", f"WITH {GROUPS}, x AS (SELECT CASE WHEN n % 7 = 0 THEN 'see LED-000001' ELSE field END AS field, n FROM d) SELECT 'identifier value' AS rule, 'field' AS column, field AS value FROM x WHERE field LIKE 'see LED%' UNION ALL SELECT 'under k', 'n', CAST(n AS VARCHAR) FROM x WHERE n < 10 UNION ALL SELECT 'not rounded', 'n', CAST(n AS VARCHAR) FROM x WHERE n % 5 <> 0")
def unsafe_cells(s: SparkSession, d: str) -> DataFrame:
    """What the scan finds in a table of raw counts in which some cells name a row."""
    x = grouped(s, d).select(F.when(F.col("n") % 7 == 0, "see LED-000001").otherwise(F.col("field")).alias("field"), "n")
    return dc.unsafe_cells(x, "n", ["n"])
