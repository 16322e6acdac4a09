"""Institutions resolved from venue cells, their names, places and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import venues as vn
from ..functions.text import match_key
from ..operators import institutions as it
from ..operators.joins import hub_join
from ..sources.tables import table as t
from .registry import query
from .ties import KEY


def named_rows(s: SparkSession, d: str) -> DataFrame:
    """(activity_id, ledger_id, name, place, key): first fragment with a kind, next one as its place."""
    a = t(s, d, "activities").select("activity_id", "ledger_id", vn.fragments(F.col("venue")).alias("f")).filter(F.size("f") > 0)
    body = F.coalesce(F.get(F.filter("f", lambda x: ~vn.kind_of(x).isin("other", "")), 0), F.get("f", 0))
    place = F.get(F.filter("f", lambda x: vn.kind_of(x) == "other"), 0)
    return a.select("activity_id", "ledger_id", body.alias("name"), place.alias("place")).withColumn("key", vn.entity_key(F.col("name"), F.col("place"))).filter("key <> ''")


@query("venue_fragments")
def venue_fragments(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", F.posexplode(vn.fragments(F.col("venue"))).alias("pos", "part")).withColumn("kind", vn.kind_of(F.col("part")))


@query("venue_kinds", r"""SELECT activity_id, CASE WHEN venue IS NULL OR trim(venue) = '' THEN '' WHEN regexp_matches(venue, '(?i)\bonline\b|\bzoom\b|온라인') THEN 'online' WHEN regexp_matches(venue, '(?i)\bfoundation\b|\bcouncil\b|재단|위원회') THEN 'funder' WHEN regexp_matches(venue, '(?i)\bmuseum\b|\bkunst(?:raum|halle)\b|미술관|박물관|전시관') THEN 'museum' WHEN regexp_matches(venue, '(?i)\bgallery\b|\bspace\b|\broom\b|갤러리|스페이스|룸') THEN 'gallery' WHEN regexp_matches(venue, '(?i)\btheat(?:re|er)\b|\bhall\b|\bfestival\b|극장|홀|축제') THEN 'stage' WHEN regexp_matches(venue, '(?i)\blab\b|\bcenter\b|\bcentre\b|랩|센터') THEN 'lab' ELSE 'other' END AS kind FROM activities""")
def venue_kinds(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", vn.kind_of(F.col("venue")).alias("kind"))


@query("institution_entities")
def institution_entities(s: SparkSession, d: str) -> DataFrame:
    """One row per body: elected name, rows, spellings, people, number by size."""
    n = named_rows(s, d)
    e = it.elected_names(n, "key", "name").join(n.groupBy("key").agg(F.countDistinct("ledger_id").alias("people")), "key")
    num = it.numbered(e.select("key", "rows"), [F.desc("rows"), F.col("key")], "key", "VEN-")
    return e.join(num, "key").select("number", "name", "rows", "spellings", "people")


@query("alias_support", f"""WITH b AS (SELECT ledger_id, {KEY.format("regexp_extract(venue, '^([^(]+)[(]', 1)")} AS x, {KEY.format("regexp_extract(venue, '^[^(]+[(]([^)]+)[)]$', 1)")} AS y FROM activities WHERE regexp_full_match(venue, '[^(,|;]+[(][^()]+[)]'))
SELECT least(x, y) AS a, greatest(x, y) AS b, count(DISTINCT ledger_id) AS support FROM b WHERE x <> '' AND y <> '' AND x <> y GROUP BY 1, 2 HAVING count(DISTINCT ledger_id) >= 2""")
def alias_support(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "activities").filter(F.col("venue").rlike(r"^[^(,|;]+[(][^()]+[)]$")).select("ledger_id", match_key(F.regexp_extract("venue", r"^([^(]+)[(]", 1)).alias("x"), match_key(F.regexp_extract("venue", r"[(]([^)]+)[)]$", 1)).alias("y"))
    return it.supported_pairs(a.filter("x <> '' AND y <> ''"), F.col("x"), F.col("y"), "ledger_id")


PARTS = r"list_filter(list_transform(regexp_split_to_array(venue, '[;；|｜、→\n\r,，()（）/]|\s[-–—]\s'), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g'))), lambda x: x <> '')"


@query("exact_places", f"WITH ref AS (SELECT DISTINCT {KEY.format('name')} AS k, canonical, country FROM place_names), x AS (SELECT activity_id, generate_subscripts(z, 1) AS pos, unnest(z) AS k FROM (SELECT activity_id, {PARTS} AS z FROM activities WHERE venue IS NOT NULL)) SELECT activity_id, canonical, country FROM (SELECT x.activity_id, canonical, country, row_number() OVER (PARTITION BY x.activity_id ORDER BY pos) AS n FROM x JOIN ref USING (k) WHERE k <> '') WHERE n = 1")
def exact_places(s: SparkSession, d: str) -> DataFrame:
    """Rows with a fragment that names a listed place letter by letter."""
    return it.placed(t(s, d, "activities"), "activity_id", vn.fragments(F.col("venue")), t(s, d, "place_names"), "name", ["canonical", "country"])


@query("institution_places")
def institution_places(s: SparkSession, d: str) -> DataFrame:
    """Place of each body by the majority of its placed rows, and whether they are unanimous."""
    n = named_rows(s, d).join(exact_places(s, d), "activity_id", "left")
    m = it.majority(n, "key", "canonical", 0.5, 2)
    u = it.unanimous(n, "key", "canonical", 3).select("key", F.lit(True).alias("unanimous"))
    return m.join(u, "key", "left").select("key", "canonical", F.coalesce("unanimous", F.lit(False)).alias("unanimous"))


@query("country_majority", "WITH n AS (SELECT region, country, count(*) AS n FROM artists GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY region) AS a, row_number() OVER (PARTITION BY region ORDER BY n DESC, country) AS k FROM n WHERE country IS NOT NULL), t AS (SELECT region, sum(n) AS a FROM n GROUP BY 1) SELECT r.region, r.country FROM r JOIN t USING (region) WHERE k = 1 AND r.n >= 0.5 * t.a")
def country_majority(s: SparkSession, d: str) -> DataFrame:
    return it.majority(t(s, d, "artists").select("region", "country"), "region", "country")


@query("unanimous_country", "SELECT affiliation, min(country) AS country FROM artists WHERE country IS NOT NULL GROUP BY 1 HAVING count(DISTINCT country) = 1 AND count(*) >= 2")
def unanimous_country(s: SparkSession, d: str) -> DataFrame:
    return it.unanimous(t(s, d, "artists").select("affiliation", "country"), "affiliation", "country", 2)


@query("guarded_groups")
def guarded_groups(s: SparkSession, d: str) -> DataFrame:
    """Rows joined by a Latin name key, but only where the group agrees in country."""
    a = t(s, d, "artists").select("ledger_id", match_key(F.col("name_en")).alias("k"), "country").filter("k <> ''")
    hub = a.groupBy("k").agg(F.min("ledger_id").alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    merged, blocked = it.guarded_components(hub_join(a, hub, "k", "inner").select("ledger_id", "h"), "ledger_id", "h", a, "ledger_id", "country")
    return merged.withColumn("state", F.lit("merged")).unionByName(blocked.withColumn("state", F.lit("blocked")))


@query("filled_countries", "WITH u AS (SELECT *, regexp_full_match(coalesce(country, ''), '[A-Z]{2}') AS ok FROM artists), v AS (SELECT affiliation, min(country) AS filled FROM u WHERE ok AND affiliation IS NOT NULL GROUP BY 1 HAVING count(DISTINCT country) = 1 AND count(*) >= 2) SELECT ledger_id, filled FROM u JOIN v USING (affiliation) WHERE NOT ok")
def filled_countries(s: SparkSession, d: str) -> DataFrame:
    """Rows without a usable country, filled from their exactly named affiliation's unanimous one."""
    a = t(s, d, "artists").select("ledger_id", "affiliation", "country")
    usable = F.col("country").rlike("^[A-Z]{2}$")
    votes = it.unanimous(a.filter(usable), "affiliation", "country", 2).withColumnRenamed("country", "filled")
    return a.filter(~F.coalesce(usable, F.lit(False))).join(votes, "affiliation").select("ledger_id", "filled")
