"""Evidence-gated resolution of people and probabilistic linkage as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import name_keys
from ..functions.text import hangul_compact, match_key
from ..functions.urls import url_key
from ..operators import linkage as ln
from ..operators.merge import filled
from ..sources.tables import table as t
from .registry import query
from .texts import site_sql
from .ties import KEY


def people(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "artists").select("ledger_id", "gy_id", "name_ko", "name_en", "affiliation", "active_since", "region", "field", "source_url")


@query("blocking_stars")
def blocking_stars(s: SparkSession, d: str) -> DataFrame:
    """Rows tied to the smallest row with an equal romanised name key."""
    p = people(s, d).withColumn("keys", name_keys(filled(F.col("name_ko"), F.col("name_en"))))
    return ln.key_stars(p, "ledger_id", F.col("keys"), "name").select("src", "dst", F.col("evidence").alias("key"))


@query("same_script_stars", f"WITH k AS (SELECT ledger_id, {KEY.format('name_en')} AS k FROM artists), h AS (SELECT k, min(ledger_id) AS h FROM k WHERE k <> '' GROUP BY 1) SELECT h.h AS src, k.ledger_id AS dst, k.k AS key FROM k JOIN h ON k.k = h.k WHERE k.ledger_id <> h.h")
def same_script_stars(s: SparkSession, d: str) -> DataFrame:
    return ln.key_stars(people(s, d), "ledger_id", F.array(match_key(F.col("name_en"))), "name").select("src", "dst", F.col("evidence").alias("key"))


def gates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(merges, queue) of all rows that share a name in either script."""
    ko, en = hangul_compact(F.col("name_ko")), match_key(F.col("name_en"))
    names = F.filter(F.array(F.concat(F.lit("k"), ko), F.concat(F.lit("e"), en)), lambda x: F.length(x) > 1)
    site = F.concat_ws("|", F.nullif(url_key(F.col("source_url")), F.lit("")), ko, en)
    place = F.concat_ws("|", "active_since", "region", "field", ko, en)
    return ln.gated_classes(people(s, d), "ledger_id", names, [("E1 site", site), ("E2 attributes", place)])


GATED = f"""p AS (SELECT *, array_to_string(regexp_extract_all(name_ko, '[가-힣]+'), '') AS hk, {KEY.format('name_en')} AS ek FROM artists),
nk AS (SELECT DISTINCT r, name FROM (SELECT ledger_id AS r, unnest(['k' || hk, 'e' || ek]) AS name FROM p) WHERE length(name) > 1),
ev AS (SELECT * FROM (SELECT ledger_id AS r, 0 AS o, 'E1 site' AS rule, concat_ws('|', nullif({site_sql('source_url')}, ''), hk, ek) AS evidence FROM p UNION ALL SELECT ledger_id, 1, 'E2 attributes', concat_ws('|', active_since, region, field, hk, ek) FROM p) WHERE evidence <> ''),
sub AS (SELECT name, o, evidence, r FROM nk JOIN ev USING (r)), hub AS (SELECT name, o, evidence, min(r) AS h FROM sub GROUP BY ALL HAVING count(*) > 1),
tie AS (SELECT DISTINCT h AS src, r AS dst FROM hub JOIN sub USING (name, o, evidence) WHERE r <> h),
m AS (SELECT src, dst, rule, evidence FROM (SELECT src, dst, x.rule, x.evidence, row_number() OVER (PARTITION BY src, dst ORDER BY x.o, x.evidence) AS k FROM tie JOIN ev x ON x.r = src JOIN ev y ON y.r = dst AND y.o = x.o AND y.evidence = x.evidence) WHERE k = 1)"""
QUEUE = f"""WITH RECURSIVE {GATED}, e AS (SELECT src AS a, dst AS b FROM m UNION SELECT dst, src FROM m), w(id, g) AS (SELECT a, a FROM e UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.id WHERE w.g < e.b),
lab AS (SELECT id, min(g) AS root FROM w GROUP BY 1), reps AS (SELECT name, min(nk.r) AS rep FROM nk LEFT JOIN lab ON lab.id = nk.r GROUP BY name, coalesce(root, nk.r))
SELECT DISTINCT src, rep AS dst FROM reps JOIN (SELECT name, min(rep) AS src FROM reps GROUP BY 1) USING (name) WHERE rep <> src"""


@query("gated_merges", f"WITH {GATED} SELECT * FROM m")
def gated_merges(s: SparkSession, d: str) -> DataFrame:
    """Rows of one name that also share evidence, tied to the smallest of them, with the rule that carries them."""
    return gates(s, d)[0]


@query("review_queue", QUEUE)
def review_queue(s: SparkSession, d: str) -> DataFrame:
    """Rows of one name without evidence: each group of merged rows once, against the smallest row of the name."""
    return gates(s, d)[1]


SURVIVORS = QUEUE.split("reps AS")[0].rstrip(", \n") + """, c AS (SELECT ledger_id, count(*) AS n FROM activities GROUP BY 1), k AS (SELECT lab.id, root, row_number() OVER (PARTITION BY root ORDER BY coalesce(n, 0) DESC, lab.id) AS p FROM lab LEFT JOIN c ON c.ledger_id = lab.id)
SELECT a.id AS dropped, b.id AS kept FROM k a JOIN k b ON a.root = b.root AND b.p = 1 WHERE a.p > 1"""


@query("merge_survivors", SURVIVORS)
def merge_survivors(s: SparkSession, d: str) -> DataFrame:
    """Who is dropped into whom: the row with most activities survives."""
    n = t(s, d, "activities").groupBy("ledger_id").agg(F.count(F.lit(1)).alias("n"))
    return ln.survivors(n, "ledger_id", "n", gated_merges(s, d))


@query("ambiguous_keys", f"SELECT {KEY.format('name_en')} AS key, count(DISTINCT region) AS groups FROM artists WHERE {KEY.format('name_en')} <> '' GROUP BY 1 HAVING count(DISTINCT region) >= 2")
def ambiguous_keys(s: SparkSession, d: str) -> DataFrame:
    return ln.ambiguous(people(s, d).select(match_key(F.col("name_en")).alias("key"), "region").filter("key <> ''"), "key", "region")


@query("linkage_probabilities")
def linkage_probabilities(s: SparkSession, d: str) -> DataFrame:
    """Match probability of all pairs of rows that share a published id or a name in either script."""
    return link_probabilities(people(s, d))


def link_probabilities(p: DataFrame) -> DataFrame:
    p = p.withColumn("ko", hangul_compact(F.col("name_ko")))
    keys = F.filter(F.array(F.concat(F.lit("g"), "gy_id"), F.concat(F.lit("k"), "ko"), F.concat(F.lit("e"), match_key(F.col("name_en")))), lambda x: F.length(x) > 1)
    pairs = ln.block_pairs(p, "ledger_id", keys)
    cols = ["ledger_id", "ko", "name_en", "active_since", "region", "field"]
    a, b = p.select([F.col(c).alias(f"a_{c}") for c in cols]), p.select([F.col(c).alias(f"b_{c}") for c in cols])
    j = pairs.join(a, F.col("src") == F.col("a_ledger_id")).join(b, F.col("dst") == F.col("b_ledger_id"))
    same = lambda c: (F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int")
    ko, en = F.nullif("a_ko", F.lit("")) == F.nullif("b_ko", F.lit("")), F.col("a_name_en") == F.col("b_name_en")
    near = F.when(F.coalesce(ko, F.lit(False)) | F.coalesce(en, F.lit(False)), 2).when(F.levenshtein("a_name_en", "b_name_en", 2).between(0, 2), 1).when(ko.isNotNull() | en.isNotNull(), 0)
    got = ln.match_weights(j.select("src", "dst", near.alias("name"), *[same(c).alias(c) for c in cols[3:]]), {c: F.col(c) for c in ("name", *cols[3:])})
    return got.select("src", "dst", F.round("probability", 6).alias("probability"))
