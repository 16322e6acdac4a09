"""Queries over packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.split import packed_rows
from ..sources.tables import table as t
from .registry import query


def _packed_sql(table: str, row_id: str, cell: str, delimiters: str, lone_comma: str) -> str:
    cut = f"regexp_replace(x, '{delimiters}', chr(1), 'g')"
    even = f"CASE WHEN i > 1 AND i < len(p) AND regexp_full_match(x, '{lone_comma}') THEN chr(1) ELSE {cut} END" if lone_comma else cut
    trim = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    unquoted = f"CASE WHEN regexp_full_match(v, chr(2) || '[^' || chr(2) || chr(3) || ']*' || chr(3)) THEN {trim.format('replace(replace(v, chr(2), %s), chr(3), %s)' % (repr(''), repr('')))} ELSE replace(replace(v, chr(2), chr(34)), chr(3), chr(34)) END"
    return f"""SELECT '{table}' AS src_table, row_id, CAST(pos AS INTEGER) AS pos, item FROM (SELECT row_id, generate_subscripts(z, 1) AS pos, unnest(z) AS item FROM (SELECT row_id, list_filter(list_transform(list_transform(string_split(replace(j, chr(3) || chr(2), chr(34)), chr(1)), lambda y: {trim.format("y")}), lambda v: {unquoted}), lambda w: w <> '') AS z FROM
(SELECT row_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = len(p) AND i % 2 = 0 THEN chr(34) || {cut} WHEN i % 2 = 1 THEN {even} ELSE chr(2) || x || chr(3) END), '') AS j FROM (SELECT {row_id} AS row_id, string_split(translate({cell}, '“”', chr(34) || chr(34)), chr(34)) AS p FROM {table} WHERE {cell} IS NOT NULL))) WHERE len(z) >= 2)"""


P5 = " UNION ALL ".join([
    _packed_sql("artists", "ledger_id", "aliases", r"[,，;；|｜/／、\t\n\r]", ""),
    _packed_sql("activities", "activity_id", "venue", r"[;；|｜、→\n\r]|[\s\p{Z}]+/{1,2}[\s\p{Z}]+|//|/[\s\p{Z}]*$", r"[\s\p{Z}]*[,，][\s\p{Z}]*"),
])


@query("p5_found", P5)
def p5_found(s: SparkSession, d: str) -> DataFrame:
    a = packed_rows(t(s, d, "artists"), "ledger_id", "aliases", "artists", "alias")
    return a.unionByName(packed_rows(t(s, d, "activities"), "activity_id", "venue", "activities", "venue"))
