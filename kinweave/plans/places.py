"""Places of venue cells, and kinds and channels of activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gazetteer as gz
from ..operators import kinds as kd
from ..operators import venue_merges as vm
from ..sources.tables import table as t
from ..storage import Scratch
from .registry import query

PARTS = r"[,，()（）]"
CODES = ("KR", "GB", "NL", "US", "CA", "ES", "AT", "DE", "TW", "JP", "BR", "FI", "FR")


def _values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ")"


def sql_key(c: str) -> str:
    return rf"""regexp_replace(regexp_replace(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '^[.,;:()\[\]"'']+|[.,;:()\[\]"'']+$', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')"""


CODE_LIST = "(" + ", ".join(f"'{c}'" for c in CODES) + ")"
TABLE = rf"""v AS (SELECT DISTINCT population, country, coalesce(admin1, '') AS admin1, coalesce(canonical, name) AS city, unnest([name, regexp_replace(name, '-(si|gun|gu|do|eup)$', '', 'i'), replace(name, '-', ''), replace(regexp_replace(name, '-(si|gun|gu|do|eup)$', '', 'i'), '-', '')]) AS n FROM place_names WHERE country IS NOT NULL AND name IS NOT NULL),
c AS (SELECT {sql_key('n')} AS key, 1 AS p, -coalesce(population, 0) AS q, city, country, admin1 FROM v WHERE n <> ''), every AS (SELECT * FROM c UNION ALL SELECT col0, 0, 0, '', 'KR', col1 FROM {_values(gz.DIVISIONS)} UNION ALL SELECT col0, 3, 0, '', col1, '' FROM {_values(gz.SHORT_COUNTRIES)}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, q, city, country, admin1) AS k FROM every WHERE length(key) >= 2) WHERE k = 1), bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY q, city, country, admin1) AS k FROM c) WHERE k = 1),
tab AS (SELECT best.key, CASE WHEN best.p = 0 AND bc.country = 'KR' AND bc.admin1 = best.admin1 THEN bc.city ELSE best.city END AS city, best.country, CASE WHEN best.p < 3 AND best.country = 'KR' THEN coalesce((SELECT col1 FROM {_values(gz.REGIONS)} WHERE col0 = best.admin1), '기타') ELSE '' END AS region FROM best LEFT JOIN bc ON bc.key = best.key)"""
DETAIL = rf"""WITH {TABLE}, f AS (SELECT activity_id, unnest(regexp_split_to_array(venue, '{PARTS}')) AS fragment, generate_subscripts(regexp_split_to_array(venue, '{PARTS}'), 1) AS pos FROM activities WHERE venue IS NOT NULL),
g AS (SELECT activity_id, pos, regexp_replace(fragment, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS fragment, {sql_key('fragment')} AS key FROM f), o AS (SELECT g.*, regexp_full_match(fragment, '[A-Z]{{2,3}}\.?') AS abbr, rtrim(fragment, '.') IN {CODE_LIST} AND regexp_full_match(fragment, '[A-Z]{{2,3}}\.?') AS coded, a.country AS c1, a.city AS n1, a.region AS r1, b.country AS c2, b.city AS n2, b.region AS r2 FROM g LEFT JOIN tab a ON a.key = g.key LEFT JOIN tab b ON b.key = regexp_replace(g.key, '(특별시|광역시|특별자치시|특별자치도|시|도|군|구)$', '')),
w AS (SELECT activity_id, pos, fragment, abbr, CASE WHEN coded THEN rtrim(fragment, '.') ELSE coalesce(c1, c2) END AS country, CASE WHEN coded THEN '' WHEN c1 IS NOT NULL THEN n1 ELSE n2 END AS city, CASE WHEN coded THEN '' WHEN c1 IS NOT NULL THEN r1 ELSE r2 END AS region, sum(CASE WHEN abbr THEN 0 ELSE 1 END) OVER (PARTITION BY activity_id ORDER BY pos) AS run FROM o),
s AS (SELECT *, first_value(CASE WHEN country IS NOT NULL THEN pos END IGNORE NULLS) OVER x AS sp, first_value(country IGNORE NULLS) OVER x AS sc, first_value(CASE WHEN country IS NOT NULL THEN region END IGNORE NULLS) OVER x AS sr FROM w WINDOW x AS (PARTITION BY activity_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT activity_id, CAST(pos AS INTEGER) AS pos, fragment, CASE WHEN abbr AND sp < pos THEN '' ELSE city END AS city, CASE WHEN abbr AND sp < pos THEN sc ELSE country END AS country, CASE WHEN abbr AND sp < pos THEN CASE WHEN sc = 'KR' THEN sr ELSE '' END ELSE region END AS region FROM s WHERE country IS NOT NULL OR (abbr AND sp < pos)"""


def venue_details(s: SparkSession, d: str) -> DataFrame:
    table = gz.place_table(t(s, d, "place_names"))
    return gz.resolve_fragments(t(s, d, "activities").filter("venue IS NOT NULL"), "activity_id", F.split("venue", PARTS, -1), table, {c: c for c in CODES})


@query("place_detail", DETAIL)
def place_detail(s: SparkSession, d: str) -> DataFrame:
    """City, country and region of every part of a venue cell that names a place."""
    return venue_details(s, d)


@query("place_table", f"WITH {TABLE} SELECT * FROM tab")
def place_table(s: SparkSession, d: str) -> DataFrame:
    return gz.place_table(t(s, d, "place_names"))


@query("person_countries", f"""WITH d AS ({DETAIL}), n AS (SELECT ledger_id, country, count(*) AS n FROM d JOIN activities USING (activity_id) WHERE ledger_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY ledger_id ORDER BY n DESC) AS k FROM n)
SELECT ledger_id, min(country) AS country, max(n) AS rows FROM r WHERE k = 1 GROUP BY 1 HAVING count(*) = 1""")
def person_countries(s: SparkSession, d: str) -> DataFrame:
    """The country most venues of a person lie in, where one is ahead of all others."""
    x = venue_details(s, d).join(t(s, d, "activities").filter("ledger_id IS NOT NULL").select("activity_id", "ledger_id"), "activity_id")
    n = x.groupBy("ledger_id", "country").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("ledger_id").agg(F.max(F.struct("n", "country")).alias("m"), F.max("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("m"), "country")).alias("first"))
    return best.filter(F.col("m.country") == F.col("first.country")).select("ledger_id", F.col("m.country").alias("country"), "rows")


CASES = lambda table, c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"
IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
WORDS = lambda c: f"list_distinct(list_concat(regexp_extract_all({c}, '[가-힣]+'), regexp_extract_all(lower({c}), '[a-z]+')))"
KINDS = rf"""WITH b AS (SELECT activity_id, coalesce(activity_type, '') AS a, coalesce(title, '') AS t, coalesce(role, '') AS r, coalesce(venue, '') AS v, coalesce(origin, '') LIKE 'cv:%' AS own, CASE WHEN source_type = 'SELF' AND activity_type IN ('talk', 'publication') THEN 'press' WHEN source_type = 'SELF' AND activity_type = 'other' THEN 'teaching' ELSE '' END AS s FROM activities),
own AS (SELECT activity_id, CASE WHEN s IN {IN(kd.PRIVATE_KIND)} THEN {CASES(kd.PRIVATE_KIND, 's')} WHEN a IN {IN(kd.TYPE_KIND)} THEN a ELSE 'other' END AS kind, CASE WHEN s IN {IN(kd.PRIVATE_KIND)} THEN 'private_section' WHEN a IN {IN(kd.TYPE_KIND)} THEN 'type_wins' ELSE 'other_residual' END AS reason, CASE WHEN regexp_matches(t || ' ' || r, '{kd.PRIVATE_TITLE}') THEN 'hidden' WHEN s IN ('teaching', 'press') THEN 'background' ELSE 'activity' END AS channel FROM b WHERE own),
ow AS (SELECT word, s, count(*) AS n FROM (SELECT s, unnest({WORDS('r')}) AS word FROM b WHERE own) GROUP BY 1, 2), rn AS (SELECT word, sum(n) AS role_n, max(n) AS top FROM ow GROUP BY 1), ts AS (SELECT word, s FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, s) AS k FROM ow) WHERE k = 1),
bn AS (SELECT word, count(*) AS both_n FROM (SELECT unnest({WORDS("r || ' ' || t")}) AS word FROM b WHERE own) GROUP BY 1), free AS (SELECT * FROM b WHERE NOT own AND a = 'other'),
ask AS (SELECT DISTINCT word FROM (SELECT unnest({WORDS("r || ' ' || t")}) AS word FROM free) WHERE length(word) >= CASE WHEN regexp_matches(word, '^[가-힣]') THEN 2 ELSE 3 END),
tell AS (SELECT word, role_n, top / role_n AS share, ts.s FROM rn JOIN ts USING (word) JOIN bn USING (word) JOIN ask USING (word) WHERE role_n >= 10 AND role_n / both_n > 0.5 AND top / role_n > 0.5 AND ts.s IN {IN(kd.PRIVATE_KIND)}),
said AS (SELECT activity_id, unnest(list_distinct(list_concat({WORDS('r')}, list_filter({WORDS('t')}, lambda w: regexp_matches(w, '^[가-힣]') OR NOT regexp_matches(t, '[가-힣]'))))) AS word FROM free),
hit AS (SELECT said.activity_id, tell.*, bool_or(tell.s = 'teaching') OVER (PARTITION BY activity_id) AS teaches FROM said JOIN tell USING (word)), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY share DESC, role_n DESC, word) AS k FROM hit WHERE NOT (teaches AND s = 'employment')) WHERE k = 1)
SELECT * FROM own UNION ALL SELECT activity_id, CASE WHEN a IN {IN(kd.TYPE_KIND)} THEN a ELSE 'other' END, CASE WHEN a IN {IN(kd.TYPE_KIND)} THEN 'roster_type' ELSE 'roster_other' END, 'activity' FROM b WHERE NOT own AND a <> 'other'
UNION ALL SELECT activity_id, CASE WHEN top.word IS NULL THEN 'other' ELSE {CASES(kd.PRIVATE_KIND, 'top.s')} END, CASE WHEN top.word IS NULL THEN 'roster_other' ELSE 'roster_token_' || top.word END, CASE WHEN top.word IS NULL THEN 'activity' ELSE {CASES(kd.PRIVATE_CHANNEL, 'top.s')} END FROM free LEFT JOIN top USING (activity_id)"""


@query("activity_kinds", KINDS)
def activity_kinds(s: SparkSession, d: str) -> DataFrame:
    """Kind, reason and channel of every activity. The tables name no section, so self-reported talks and publications stand for press, untyped rows for teaching."""
    self = F.col("source_type") == "SELF"
    section = F.when(self & F.col("activity_type").isin("talk", "publication"), "cv_section=press").when(self & (F.col("activity_type") == "other"), "cv_section=teaching")
    return kd.classify(t(s, d, "activities").withColumn("reviewer_note", section), "activity_id", F.col("origin").startswith("cv:"))


def institutions(s: SparkSession, d: str) -> DataFrame:
    """(activity_id, name, town): the first part of each venue that is no place, and the first city written with it."""
    parts = t(s, d, "activities").filter("venue IS NOT NULL").select("activity_id", vm.fragments(F.col("venue")).alias("parts"))
    found = gz.resolve_fragments(parts, "activity_id", F.col("parts"), gz.place_table(t(s, d, "place_names")), {c: c for c in CODES})
    places = found.groupBy("activity_id").agg(F.collect_set("pos").alias("at"), F.min(F.when(F.col("city") != "", F.struct("pos", "city"))).alias("c"))
    j = parts.join(places, "activity_id", "left")
    name = F.get(F.filter("parts", lambda x, i: ~F.array_contains(F.coalesce("at", F.array().cast("array<int>")), i + 1)), 0)
    return j.select("activity_id", name.alias("name"), F.lower("c.city").alias("town")).filter("name IS NOT NULL")


def resolved(s: SparkSession, d: str, rules: tuple[str, ...] = ("V7", "V8", "V9")) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = Scratch(s, "institutions").save(institutions(s, d), "rows")
    table = gz.place_table(t(s, d, "place_names"))
    return rows, *vm.venue_entities(rows, "name", "town", table, "key", "city", rules)


@query("resolved_venues")
def resolved_venues(s: SparkSession, d: str) -> DataFrame:
    """The institution of every activity whose venue names one, spellings, rooms and scripts merged."""
    rows, entities, _ = resolved(s, d)
    ents = entities.groupBy("name", "town").agg(F.min("entity").alias("entity"))
    return rows.withColumn("town", F.coalesce("town", F.lit(""))).join(ents, ["name", "town"]).select("activity_id", "name", "entity")


@query("venue_merges")
def venue_merges(s: SparkSession, d: str) -> DataFrame:
    """The merges of institution keys and the rule of each."""
    return resolved(s, d)[2]


@query("venue_layers")
def venue_layers(s: SparkSession, d: str) -> DataFrame:
    """Institutions left under no rule and under each further one."""
    out = []
    for name, rules in (("keys", ()), ("V7", ("V7",)), ("V8", ("V7", "V8")), ("V9", ("V7", "V8", "V9"))):
        out.append(resolved(s, d, rules)[1].agg(F.countDistinct("entity").alias("entities")).select(F.lit(name).alias("layer"), "entities"))
    return reduce(DataFrame.unionByName, out)
