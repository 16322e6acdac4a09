"""SQL counterparts of the queries SQL can express, over whole tables."""

P1 = """WITH RECURSIVE e AS (SELECT kept AS a, dropped AS b FROM merge_records WHERE kept <> dropped UNION SELECT dropped, kept FROM merge_records WHERE kept <> dropped),
r(id, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id WHERE r.g < e.b)
SELECT id AS ledger_id, min(g) AS group_id FROM r GROUP BY 1"""

STANDS = "('-', '--', '?', 'n/a', 'none', 'null', 'tbd', 'unknown', '미상', '미정', '없음', '')"
VALUE = rf"regexp_replace({{0}}, '^[\s\p{{{{Z}}}}]+|[\s\p{{{{Z}}}}]+$', '', 'g')"


def _has(c: str) -> str:
    return f"(lower({VALUE.format(c).replace('{{', '{').replace('}}', '}')}) NOT IN {STANDS})"


P3_ONE = """SELECT gy_id, '{f}' AS field, ledger_id FROM (SELECT *, row_number() OVER (PARTITION BY gy_id ORDER BY (verification IS NOT DISTINCT FROM 'VERIFIED') DESC, ts DESC NULLS LAST, ledger_id) AS k FROM a WHERE {has}) WHERE k = 1"""
P3 = (
    r"""WITH t AS (SELECT *, trim(updated_at) AS u FROM artists), b AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(u, '^\d{4}-\d{2}-\d{2}$') THEN u || ' 00:00:00+00' WHEN regexp_matches(u, '(Z|[+-]\d{2}:\d{2})$') THEN u WHEN regexp_matches(u, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') THEN u || '+00' END AS TIMESTAMPTZ) AS ts FROM t WHERE """
    + _has("gy_id")
    + "), a AS (SELECT * FROM b WHERE gy_id IN (SELECT gy_id FROM b GROUP BY 1 HAVING count(*) >= 2)) "
    + " UNION ALL ".join(P3_ONE.format(f=f, has=_has(f)) for f in ("name_en", "affiliation", "country"))
)

LOW = "replace(translate(lower({}), 'ς', 'σ'), 'ß', 'ss')"
BARE = r"regexp_replace(" + LOW + r", '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
P4_KEY = rf"""SELECT activity_id, ledger_id, {BARE.format("title")} AS t, array_to_string(list_sort(list_filter(regexp_split_to_array({LOW.format('venue')}, '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')), ' ') AS v, regexp_replace({BARE.format("year")}, '([0-9])(년|年)$', '\1') AS y FROM activities WHERE ledger_id IS NOT NULL AND regexp_replace(title, '[\s\p{{Z}}]+', '', 'g') <> '' AND regexp_replace(venue, '[\s\p{{Z}}]+', '', 'g') <> '' AND regexp_replace(year, '[\s\p{{Z}}]+', '', 'g') <> ''"""
P4 = f"WITH k AS ({P4_KEY}), f AS (SELECT *, min(activity_id) OVER (PARTITION BY ledger_id, t, v, y) AS first_id FROM k) SELECT first_id, activity_id AS copy_id FROM f WHERE first_id <> activity_id"
P4_RECORDS = f"SELECT first_id, count(*) + 1 AS copies FROM ({P4}) GROUP BY 1"

WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}\s\p{Z}]', '', 'g'), '[\s\p{Z}]+'), lambda x: x <> '')"
RUNS = "SELECT DISTINCT {i}, array_to_string(list_slice(w, k, k + 11), ' ') AS run FROM (SELECT {i}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {i}, " + WORDS.replace("{", "{{").replace("}", "}}") + " AS w FROM {t} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
P9 = f"SELECT DISTINCT d.doc_id, i.item_id FROM ({RUNS.format(i='doc_id', t='documents')}) d JOIN ({RUNS.format(i='item_id', t='eval_items')}) i ON d.run = i.run"

SQL = {"p1_found": P1, "p3_found": P3, "p4_found": P4, "p4_records": P4_RECORDS, "p9_found": P9}
