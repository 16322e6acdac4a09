"""Co-presence ties, their ablation by key, and partitions scored against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import code_year, year_of
from ..functions.text import match_key
from ..operators import copresence as co
from ..operators import partitions as pt
from ..operators.sequences import restating
from ..sources.tables import table as t
from .registry import query

EVENT_GROUPS = """SELECT DISTINCT event_type, date_trunc('hour', ts) AS h, user_id FROM events WHERE user_id IS NOT NULL"""
EVENT_TIES = f"""g AS ({EVENT_GROUPS}), ties AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM g a JOIN g b ON a.event_type = b.event_type AND a.h = b.h AND a.user_id < b.user_id)"""
YEAR = "TRY_CAST(NULLIF(regexp_extract(year, '(19[0-9]{2}|20[0-9]{2})', 1), '') AS INTEGER)"
#: Letters that case folding spells out; the rest of it is lower case.
FOLDED = {"ß": "ss", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s", "ŉ": "ʼn", "µ": "μ"}


def fold_sql(c: str) -> str:
    """Case folding in SQL."""
    out = f"lower({c})"
    for a, b in FOLDED.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


#: Match key in SQL; a column goes in.
KEY = fold_sql(r"regexp_replace(nfc_normalize({}), '[^\p{{L}}\p{{N}}]+', '', 'g')")


def event_members(s: SparkSession, d: str) -> DataFrame:
    return co.presences(t(s, d, "events"), "user_id", [F.col("event_type"), F.date_trunc("hour", "ts")], F.lit(True))


def event_ties(s: SparkSession, d: str) -> DataFrame:
    return co.pairs_of(event_members(s, d))


def kept_activities(s: SparkSession, d: str) -> DataFrame:
    """Publishable rows with a year, a venue and a person."""
    a = t(s, d, "activities").select("activity_id", "ledger_id", "title", "venue", year_of(F.col("year")).alias("year"), "activity_type", "publishable", "origin")
    return a.filter((F.coalesce(F.lower(F.trim("publishable")), F.lit("yes")) != "no") & F.col("year").isNotNull())


KEPT = f"kept AS (SELECT activity_id, ledger_id, title, venue, {YEAR} AS year, activity_type, origin FROM activities WHERE coalesce(lower(trim(publishable)), 'yes') <> 'no' AND {YEAR} IS NOT NULL)"


@query("copresence_ties", f"WITH {EVENT_TIES} SELECT src, dst FROM ties")
def copresence_ties(s: SparkSession, d: str) -> DataFrame:
    return event_ties(s, d)


@query("copresence_degree", f"WITH {EVENT_TIES} SELECT e AS entity, count(*) AS degree FROM (SELECT src AS e FROM ties UNION ALL SELECT dst FROM ties) GROUP BY e")
def copresence_degree(s: SparkSession, d: str) -> DataFrame:
    return co.degrees_of(event_members(s, d))


@query("copresence_limited", f"WITH {EVENT_TIES} SELECT src, dst FROM ties WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND dst IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def copresence_limited(s: SparkSession, d: str) -> DataFrame:
    return co.pairs_of(co.among(event_members(s, d), t(s, d, "customer").filter("c_acctbal > 0"), "c_custkey"))


def _venue_groups() -> str:
    return f"g AS (SELECT DISTINCT {KEY.format('venue')} AS v, year, ledger_id FROM kept WHERE {KEY.format('venue')} <> '' AND ledger_id IS NOT NULL)"


@query("venue_year_ties", f"WITH {KEPT}, {_venue_groups()} SELECT DISTINCT a.ledger_id AS src, b.ledger_id AS dst FROM g a JOIN g b ON a.v = b.v AND a.year = b.year AND a.ledger_id < b.ledger_id")
def venue_year_ties(s: SparkSession, d: str) -> DataFrame:
    v = F.nullif(match_key(F.col("venue")), F.lit(""))
    return co.pairs_of(co.presences(kept_activities(s, d), "ledger_id", [v, F.col("year")], F.lit(True)))


def _layer_sql(k: int, name: str, key: str) -> str:
    return f"l{k} AS (WITH g AS (SELECT DISTINCT {key} AS v, year, ledger_id FROM kept WHERE {key} <> '' AND ledger_id IS NOT NULL) SELECT DISTINCT a.ledger_id AS src, b.ledger_id AS dst, {k} AS k, '{name}' AS layer FROM g a JOIN g b ON a.v = b.v AND a.year = b.year AND a.ledger_id < b.ledger_id)"


FIRST_WORDS = r"regexp_extract(venue, '^[^,(]+')"
LAYERS = ",".join([_layer_sql(0, "typed", "trim(venue)"), _layer_sql(1, "letters", KEY.format("venue")), _layer_sql(2, "part", KEY.format(FIRST_WORDS))])


@query("layer_ablation", f"WITH {KEPT}, {LAYERS}, every AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2), firsts AS (SELECT src, dst, min(k) AS k FROM every GROUP BY src, dst), added AS (SELECT k, count(*) AS added FROM firsts GROUP BY k) SELECT e.layer, count(*) AS ties, coalesce(max(a.added), 0) AS added FROM every e LEFT JOIN added a ON a.k = e.k GROUP BY e.layer")
def layer_ablation(s: SparkSession, d: str) -> DataFrame:
    blank = F.lit("")
    part = match_key(F.regexp_extract("venue", r"^[^,(]+", 0))
    keys = {"typed": [F.nullif(F.trim("venue"), blank), F.col("year")], "letters": [F.nullif(match_key(F.col("venue")), blank), F.col("year")], "part": [F.nullif(part, blank), F.col("year")]}
    return co.layers(kept_activities(s, d), "ledger_id", F.lit(True), keys)


@query("anti_restates", f"""WITH {KEPT}, own AS (SELECT DISTINCT ledger_id, TRY_CAST(NULLIF(regexp_extract(frame_code, '-([0-9]{{4}})$', 1), '') AS INTEGER) AS y, lower(substr(frame_code, 1, 2)) AS n FROM frame_membership)
SELECT activity_id, ledger_id, year FROM kept k WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.ledger_id = k.ledger_id AND o.y = k.year AND contains(lower(k.title), o.n))""")
def anti_restates(s: SparkSession, d: str) -> DataFrame:
    own = t(s, d, "frame_membership").select("ledger_id", code_year(F.col("frame_code")).alias("year"), F.lower(F.substring("frame_code", 1, 2)).alias("n"))
    got = restating(kept_activities(s, d), own, "ledger_id", "year", F.lower("title"), F.col("n"))
    return got.select("activity_id", "ledger_id", "year")


@query("coverage_sizes", """WITH a AS (SELECT ledger_id, NULLIF(trim(affiliation), '') AS g FROM artists), z AS (SELECT g, count(*) AS n FROM a GROUP BY g)
SELECT CAST(sum(n) AS BIGINT) AS entities, CAST(coalesce(sum(n) FILTER (g IS NOT NULL), 0) AS BIGINT) AS placed, round(CAST(sum(n) FILTER (g IS NOT NULL) AS DOUBLE) / sum(n), 9) AS share, count(g) AS groups, round(CAST(max(n) FILTER (g IS NOT NULL) AS DOUBLE) / sum(n) FILTER (g IS NOT NULL), 9) AS largest_share, count(*) FILTER (g IS NOT NULL AND n = 1) AS singletons FROM z""")
def coverage_sizes(s: SparkSession, d: str) -> DataFrame:
    return pt.coverage(t(s, d, "artists").select("ledger_id", F.nullif(F.trim("affiliation"), F.lit("")).alias("g")), "ledger_id", "g")


@query("contingency_ari", """WITH c AS (SELECT c_mktsegment AS l, c_nationkey AS r, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1, 2),
x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY l)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY r))
SELECT round(2 * (s * (t * (t - 1) / 2) - a * b) / ((t * (t - 1) / 2) * (a + b) - 2 * a * b), 9) AS ari FROM x, a, b""")
def contingency_ari(s: SparkSession, d: str) -> DataFrame:
    return pt.adjusted_rand(t(s, d, "customer"), "c_mktsegment", "c_nationkey")


@query("lift_auc", f"""WITH {EVENT_TIES}, p AS (SELECT c_custkey AS e, c_mktsegment AS g FROM customer), z AS (SELECT g, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY g),
base AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n) * (sum(n) - 1) / 2 AS total FROM z), tied AS (SELECT CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER (x.g = y.g) AS DOUBLE) AS s FROM ties JOIN p x ON x.e = src JOIN p y ON y.e = dst)
SELECT CAST(t AS BIGINT) AS ties, CAST(s AS BIGINT) AS inside, round((s / t) / (same / total), 9) AS lift, round((s / t + 1 - (same - s) / (total - t)) / 2, 9) AS auc FROM base, tied""")
def lift_auc(s: SparkSession, d: str) -> DataFrame:
    return pt.copresent_lift(t(s, d, "customer"), "c_custkey", "c_mktsegment", event_members(s, d))


@query("bootstrap_ci")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return pt.bootstrap_mean(t(s, d, "customer"), "c_custkey", "c_acctbal", ["c_mktsegment"])


@query("counted_scores", f"""WITH {EVENT_TIES}, p AS (SELECT c_custkey AS e, c_mktsegment AS g, CAST(c_custkey % 3 AS DOUBLE) AS c FROM customer WHERE c_custkey % 3 > 0), z AS (SELECT g, sum(c) AS n, sum(c * (c - 1) / 2) AS o FROM p GROUP BY g),
b AS (SELECT sum(n) * (sum(n) - 1) / 2 - sum(o) AS total, sum(n * (n - 1) / 2) - sum(o) AS same FROM z), u AS (SELECT sum(x.c * y.c) AS t, sum(CASE WHEN x.g = y.g THEN x.c * y.c ELSE 0 END) AS s FROM ties JOIN p x ON x.e = src JOIN p y ON y.e = dst)
SELECT CAST(total AS BIGINT) AS pairs, CAST(t AS BIGINT) AS ties, CAST(s AS BIGINT) AS inside, round((s / t) / (same / total), 9) AS lift, round((s / t + 1 - (same - s) / (total - t)) / 2, 9) AS auc FROM b, u""")
def counted_scores(s: SparkSession, d: str) -> DataFrame:
    """Lift and AUC where customers are present none to two times."""
    people = t(s, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 3).alias("times"))
    return pt.counted_scores(people, "c_custkey", "c_mktsegment", "times", event_ties(s, d))


@query("score_intervals")
def score_intervals(s: SparkSession, d: str) -> DataFrame:
    return pt.copresent_intervals(t(s, d, "customer"), "c_custkey", "c_mktsegment", event_members(s, d))


@query("partition_stability")
def partition_stability(s: SparkSession, d: str) -> DataFrame:
    return pt.stability(t(s, d, "customer"), "c_custkey", "c_mktsegment", "c_nationkey")
