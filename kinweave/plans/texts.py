"""Scalar text functions, packed notes, JSON and token statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ur
from ..functions.dates import year_of
from ..operators.joins import hub_join
from ..sources.tables import table as t
from .registry import query
from .ties import KEY


@query("text_keys", f"SELECT activity_id, {KEY.format('title')} AS title_key, regexp_replace({KEY.format('title')}, '[0-9]+$', '') AS base, TRY_CAST(NULLIF(regexp_extract(year, '(19[0-9]{{2}}|20[0-9]{{2}})', 1), '') AS INTEGER) AS year FROM activities")
def text_keys(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", tx.match_key(F.col("title")).alias("title_key"), tx.title_base(F.col("title")).alias("base"), year_of(F.col("year")).alias("year"))


@query("script_share", "WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) AS ko, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN ko + en = 0 THEN '' WHEN ko >= (ko + en) * 0.2 AND en >= (ko + en) * 0.2 THEN 'mixed' WHEN ko >= (ko + en) * 0.2 THEN 'ko' ELSE 'en' END AS script, ko * 2 > ko + en AS hangul FROM c")
def script_share(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.lang_of(F.col("text")).alias("script"), tx.mostly_hangul(F.col("text")).alias("hangul"))


@query("word_sets", "SELECT activity_id, list_sort(list_distinct(list_concat(regexp_extract_all(title, '[가-힣]+'), regexp_extract_all(lower(title), '[a-z]+')))) AS words FROM activities WHERE title IS NOT NULL")
def word_sets(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").filter("title IS NOT NULL").select("activity_id", F.array_sort(tx.words_of(F.col("title"))).alias("words"))


@query("url_keys", r"SELECT activity_id, regexp_replace(regexp_extract(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\.', '') AS host FROM activities")
def url_keys(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", ur.domain_of(F.col("source_url")).alias("host"))


HOST = r"regexp_replace(regexp_extract(lower(trim({})), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\.', '')"
BARE = r"regexp_replace(regexp_replace(lower(trim({})), '^https?://(www\.)?', ''), '[?#].*$', '')"
#: Website identity in SQL; a column name goes in.
SITE = "CASE WHEN regexp_matches(split_part({b}, '/', 1), '{shared}') THEN split_part({b}, '/', 1) || '/' || trim(regexp_replace(CASE WHEN contains({b}, '/') THEN substr({b}, strpos({b}, '/') + 1) ELSE '' END, 'index\\.(html?|php)$', ''), '/') ELSE split_part({b}, '/', 1) END"


def site_sql(column: str) -> str:
    return SITE.format(b=BARE.format(column), shared=ur.host_pattern(ur.SHARED_HOSTS))


KIND = r"""CASE WHEN h = 'drive.google.com' THEN CASE WHEN contains(p, '/folders/') THEN 'gdrive_folder' ELSE 'gdrive_file' END WHEN h = 'docs.google.com' AND contains(p, '/document/d/') THEN 'gdoc' WHEN h = 'docs.google.com' AND contains(p, '/spreadsheets/d/') THEN 'gsheet'
WHEN suffix(p, '.pdf') THEN 'pdf' WHEN suffix(p, '.docx') THEN 'docx' WHEN suffix(p, '.hwp') THEN 'hwp' ELSE 'web' END"""


@query("surt_keys", rf"""WITH u AS (SELECT activity_id, lower(trim(source_url)) AS u, {HOST.format("source_url")} AS host, {site_sql("source_url")} AS site, regexp_replace(lower(source_url), '[?#].*$', '') AS q FROM activities),
x AS (SELECT *, regexp_extract(q, '^[a-z][a-z0-9+.-]*://([^/]*)', 1) AS h, regexp_extract(q, '^(?:[a-z][a-z0-9+.-]*://[^/]*)?(.*)$', 1) AS p FROM u)
SELECT activity_id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]+(/[^?#]*)?', 1) AS surt, site, {KIND} AS kind, regexp_matches(host, '{ur.host_pattern(ur.SOCIAL_HOSTS)}') AS social FROM x""")
def surt_keys(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "activities").select("activity_id", ur.surt(F.col("source_url")).alias("surt"), ur.url_key(F.col("source_url")).alias("site"), ur.detect_kind(F.col("source_url")).alias("kind"), ur.is_social(F.col("source_url")).alias("social"))


@query("link_types", rf"""WITH x AS (SELECT artists.ledger_id, {HOST.format("source_url")} AS h FROM artists) SELECT ledger_id, CASE WHEN regexp_matches(h, '{ur.host_pattern(ur.SOCIAL_HOSTS)}') THEN 'social' WHEN regexp_matches(h, '{ur.host_pattern(ur.VIDEO_HOSTS)}') THEN 'video' WHEN regexp_matches(h, '{ur.host_pattern(ur.REPOSITORY_HOSTS)}') THEN 'repository' ELSE 'website' END AS link_type FROM x""")
def link_types(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "artists").select("ledger_id", ur.link_type(F.col("source_url")).alias("link_type"))


PARTS = {k: "['" + "', '".join(v) + "']" for k, v in (("on", tx.ONSETS), ("nu", tx.NUCLEI), ("co", tx.CODAS))}
LATIN = f"array_to_string(list_transform(regexp_extract_all(name_ko, '(?s).'), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN ({PARTS['on']})[(unicode(c) - 44032) // 588 + 1] || ({PARTS['nu']})[(unicode(c) - 44032) % 588 // 28 + 1] || ({PARTS['co']})[(unicode(c) - 44032) % 28 + 1] ELSE c END), '')"
CONFUSED = reduce(lambda x, ab: f"replace({x}, '{ab[0]}', '{ab[1]}')", tx.CONFUSED, "regexp_replace(lower(latin), '[^a-z0-9]', '', 'g')")


@query("romanised_names", f"WITH l AS (SELECT ledger_id, {LATIN} AS latin FROM artists WHERE name_ko IS NOT NULL), c AS (SELECT *, regexp_extract_all({CONFUSED}, '(?s).') AS cs FROM l) SELECT ledger_id, latin, array_to_string(list_filter(cs, lambda x, i: i = 1 OR x <> cs[i - 1]), '') AS skeleton FROM c")
def romanised_names(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "artists").filter("name_ko IS NOT NULL").select("ledger_id", tx.romanise(F.col("name_ko")).alias("latin"), tx.skeleton(tx.romanise(F.col("name_ko"))).alias("skeleton"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("token_stats", """WITH w AS (SELECT doc_kind, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS word FROM documents WHERE text IS NOT NULL AND doc_kind IS NOT NULL), n AS (SELECT word, doc_kind, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY n DESC, doc_kind) AS k FROM n)
SELECT word, CAST(total AS BIGINT) AS docs, doc_kind AS modal_kind, round(CAST(n AS DOUBLE) / total, 9) AS share FROM m WHERE k = 1 AND total >= 10""")
def token_stats(s: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    w = t(s, d, "documents").filter("text IS NOT NULL AND doc_kind IS NOT NULL").select("doc_kind", F.explode(words).alias("word"))
    n = w.groupBy("word", "doc_kind").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("word").agg(F.sum("n").alias("docs"), F.min_by(F.struct("doc_kind", "n"), F.struct(-F.col("n"), F.col("doc_kind"))).alias("m")).filter("docs >= 10")
    return g.select("word", "docs", F.col("m.doc_kind").alias("modal_kind"), F.round(F.col("m.n") / F.col("docs"), 9).alias("share"))


@query("title_classes", f"""WITH k AS (SELECT activity_id, {KEY.format('title')} AS key FROM activities WHERE {KEY.format('title')} <> ''), h AS (SELECT key, min(activity_id) AS class_id, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1) SELECT k.activity_id, h.class_id, h.n AS members FROM k JOIN h USING (key)""")
def title_classes(s: SparkSession, d: str) -> DataFrame:
    """Rows of equal title key with their class; copies are members, not pairs."""
    k = t(s, d, "activities").select("activity_id", tx.match_key(F.col("title")).alias("key")).filter("key <> ''")
    h = k.groupBy("key").agg(F.min("activity_id").alias("class_id"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return hub_join(k, h, "key", "inner").select("activity_id", "class_id", "members")


@query("content_digest")
def content_digest(s: SparkSession, d: str) -> DataFrame:
    """One order-free digest of a table: sums of row hashes, so no row order and no single big string."""
    a = t(s, d, "artists")
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in a.columns])
    return a.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("digest_sum"), F.bit_xor(h).alias("digest_xor"))


@query("citations", "SELECT ledger_id, coalesce(name_en, '') || ' (' || coalesce(active_since, 'n.d.') || '). ' || coalesce(field, '') || '. Retrieved from ' || coalesce(source_url, '') AS citation FROM artists")
def citations(s: SparkSession, d: str) -> DataFrame:
    c = lambda x, e="": F.coalesce(F.col(x), F.lit(e))
    return t(s, d, "artists").select("ledger_id", F.concat(c("name_en"), F.lit(" ("), c("active_since", "n.d."), F.lit("). "), c("field"), F.lit(". Retrieved from "), c("source_url")).alias("citation"))
