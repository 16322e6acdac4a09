"""Keys, fingerprints, marks and labels of archive rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import archive as ar
from ..sources.tables import table as t
from .registry import query
from .ties import fold_sql

TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
#: Composed, without controls, spaces to one, trimmed, case folded.
COLLAPSE = fold_sql(r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({}), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')")
#: A capital sigma at the end of a word has a lower-case form of its own.
IDENTITY = r"regexp_replace(lower(regexp_replace(coalesce(title, ''), '(\p{L})Σ([^\p{L}]|$)', '\1ς\2', 'g')), '[^\p{L}\p{N}]+', '', 'g')"
ROW = ("ledger_id", "title", "year", "activity_type", "venue", "origin", "source_url")


@query("activity_keys", rf"""WITH x AS (SELECT *, coalesce(origin, '') AS o, coalesce(venue, '') AS v FROM activities), k AS (SELECT *, array_to_string([{IDENTITY}, coalesce(year, '')], chr(31)) AS ty, {TRIM.format('v')} AS vv FROM x)
SELECT activity_id, array_to_string([coalesce(ledger_id, ''), CASE WHEN starts_with(o, 'cv:') THEN substr(o, 4) ELSE '' END, ty, coalesce(activity_type, ''), vv], chr(31)) AS listed,
array_to_string([coalesce(ledger_id, ''), coalesce(source_url, ''), ty, CASE WHEN coalesce(activity_type, '') = '' THEN 'other' ELSE activity_type END, vv], chr(31)) || CASE WHEN o <> '' THEN chr(31) || o ELSE '' END AS collected,
substr(sha256(array_to_string([regexp_replace(o, '^cv:', ''), {TRIM.format("coalesce(year, '')")}, coalesce(activity_type, ''), {COLLAPSE.format("coalesce(title, '')")}, {COLLAPSE.format('v')}], chr(31))), 1, 16) AS reading FROM k""")
def activity_keys(s: SparkSession, d: str) -> DataFrame:
    """The identity keys of every row as read from a document, as collected, and as a reading."""
    row = {c: F.col(c) for c in ROW}
    return t(s, d, "activities").select("activity_id", ar.listed_key(row).alias("listed"), ar.collected_key(row).alias("collected"), ar.reading_key(row).alias("reading"))


@query("text_fingerprints", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '[\s\p{Z}]+', '', 'g')) AS fingerprint FROM documents WHERE text IS NOT NULL")
def text_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").filter("text IS NOT NULL").select("doc_id", ar.fingerprint(F.col("text")).alias("fingerprint"))


BARE = r"regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '[\s\p{Z}]+', '', 'g')"


@query("source_bundles", f"SELECT ledger_id, count(*) AS documents, sha256(string_agg({BARE}, '' ORDER BY doc_id)) AS bundle FROM documents WHERE text IS NOT NULL AND ledger_id IS NOT NULL GROUP BY 1")
def source_bundles(s: SparkSession, d: str) -> DataFrame:
    """One fingerprint of all texts of a person, in the order of their ids."""
    docs = t(s, d, "documents").filter("text IS NOT NULL AND ledger_id IS NOT NULL")
    # texts are shortened to what counts before they are gathered
    kept = docs.select("ledger_id", F.struct(F.col("doc_id").alias("id"), F.regexp_replace(F.regexp_replace("text", ar.ZERO_WIDTH, ""), ar.SPACES, "").alias("text")).alias("d"))
    return kept.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("documents"), F.collect_list("d").alias("all")).select("ledger_id", "documents", ar.bundle_fingerprint(F.col("all")).alias("bundle"))


@query("merge_strata", r"SELECT CASE WHEN regexp_full_match(trim(coalesce(rule, '')), '(?:X1\+)?E[1-4]') THEN trim(rule) ELSE 'uncoded' END AS stratum, nullif(regexp_extract(rule || ' ' || coalesce(evidence, ''), '^((?:X1\+)?E[1-4])(?: |$)', 1), '') AS named, count(*) AS merges FROM merge_records GROUP BY 1, 2")
def merge_strata(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "merge_records").select(ar.stratum_of(F.col("rule")).alias("stratum"), ar.rule_of(F.concat("rule", F.lit(" "), F.coalesce("evidence", F.lit("")))).alias("named"))
    return m.groupBy("stratum", "named").agg(F.count(F.lit(1)).alias("merges"))


@query("parsed_marks", r"SELECT dropped, coalesce(regexp_replace(evidence, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS evidence, coalesce(trim(rule), '') AS rule, count(*) AS n FROM merge_records WHERE dropped IS NOT NULL AND coalesce(evidence, '') NOT LIKE '%;%' GROUP BY 1, 2, 3")
def parsed_marks(s: SparkSession, d: str) -> DataFrame:
    """Merge records written as notes and read back."""
    m = t(s, d, "merge_records").filter("dropped IS NOT NULL AND coalesce(evidence, '') NOT LIKE '%;%'")
    note = F.concat(F.lit("seen=1; merged "), "dropped", F.lit("; merge_evidence="), F.coalesce("evidence", F.lit("")), F.lit("; rule="), F.coalesce("rule", F.lit("")))
    return m.select(F.explode(ar.merge_marks(note)).alias("m")).select("m.*").groupBy("dropped", "evidence", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("person_pseudonyms")
def person_pseudonyms(s: SparkSession, d: str) -> DataFrame:
    """A stable pseudonym for every person (a fixed key, as the tables are synthetic)."""
    return t(s, d, "artists").select("ledger_id", ar.pseudonym(F.col("ledger_id"), b"example key").alias("pseudonym"))


@query("name_credits")
def name_credits(s: SparkSession, d: str) -> DataFrame:
    """Names of artists read as roster credits."""
    c = F.coalesce("name_ko", "name_en")
    return t(s, d, "artists").select("ledger_id", ar.credit(c).alias("c"), ar.credit_members(c).alias("members"), ar.latin_personal_form(F.col("name_en")).alias("form")).select("ledger_id", "c.*", "members", "form")


@query("code_families", "SELECT CASE WHEN starts_with(b, 'HN') THEN 'north' WHEN b = 'VOX' THEN 'voices' ELSE b END AS family, count(*) AS rows FROM (SELECT regexp_replace(coalesce(frame_code, ''), '-[0-9]{4}$', '') AS b FROM frame_membership) GROUP BY 1")
def code_families(s: SparkSession, d: str) -> DataFrame:
    f = ar.family_of(F.col("frame_code"), [("HN", "north")], [("VOX", "voices")])
    return t(s, d, "frame_membership").groupBy(f.alias("family")).agg(F.count(F.lit(1)).alias("rows"))


@query("collapsed_texts", f"SELECT doc_id, md5({COLLAPSE.format('text')}) AS collapsed, md5({COLLAPSE.format(r'regexp_replace(nfc_normalize(text), $re$[^\p{L}\p{N}\s\p{Z}]$re$, $re$ $re$, $re$g$re$)')}) AS words FROM documents WHERE text IS NOT NULL")
def collapsed_texts(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.md5(ar.collapse(F.col("text"))).alias("collapsed"), F.md5(ar.strip_punct(F.col("text"))).alias("words"))


@query("note_tokens", r"SELECT ledger_id, trim(split_part(x, '=', 1)) AS token, trim(substr(x, strpos(x, '=') + 1)) AS value FROM (SELECT ledger_id, unnest(string_split(reviewer_note, ';')) AS x FROM artists) WHERE contains(x, '=')")
def note_tokens(s: SparkSession, d: str) -> DataFrame:
    """The ``key=value`` parts of notes."""
    part = F.explode(F.filter(F.split("reviewer_note", ";"), lambda x: x.contains("="))).alias("x")
    return t(s, d, "artists").select("ledger_id", part).select("ledger_id", F.trim(F.split("x", "=", 2)[0]).alias("token"), F.trim(F.split("x", "=", 2)[1]).alias("value"))
