import datetime as dt
import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from kinweave.functions import archive as ar

from .test_functions import each


def test_texts(spark):
    assert each(spark, ar.collapse, [" A\u0007B  c D ", "STRASSE", None]) == ["ab c d", "strasse", None]
    assert each(spark, ar.strip_punct, ["A-b_c (d)!", ""]) == ["a b c d", ""]
    assert each(spark, ar.source_lines, ["a \t b\r\n\r\n​\n c "]) == ["a b\nc"]
    assert each(spark, ar.fingerprint, ["a b\n c", "abc", "a​bc"]) == [hashlib.sha256(b"abc").hexdigest()] * 3
    df = spark.createDataFrame([([("2", "b c"), ("1", "a")],)], "d array<struct<id:string,text:string>>")
    got = df.select(ar.bundle_fingerprint(F.col("d")), ar.replay_key(F.col("d"), "v/2")).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == sha("abc") and got[1] == sha(f"v/2\n1 {sha('a')}\n2 {sha('bc')}")
    taken = F.lit(dt.date(2026, 1, 15))
    assert each(spark, lambda c: ar.relative_years(c, taken), ["20 days ago, 3089 Days  ago", "1200 days", None]) == [[2017, 2025], [], None]


@pytest.mark.parametrize("needle,text,want", [
    ("부산현대미술", "부산현대미술관에서", False), ("부산현대미술관", "부산현대미술관에서 열린", True), ("푸른 신호", "푸른  신호전", True), ("푸른 신호", "푸른 신호등", False), ("시립", "경기시립", False),
    ("Book", "Books", False), ("Book", "a book Book는", True), ("A.C", "A.C.", True), ("A.C", "ABC", False), ("", "x", False), ("a", None, False), ("C++", "in C++ and", True),
])
def test_whole_words(spark, needle, text, want):
    df = spark.createDataFrame([(needle, text)], "n string, t string")
    assert df.select(ar.occurs(F.col("n"), F.col("t"))).first()[0] is want


def test_loose_spaces(spark):
    assert each(spark, lambda c: ar.occurs(F.lit("아르코미술관"), c, True), ["아르코 미술관은", "아르코미술 관", "아르코미술관련"]) == [True, True, False]


def test_keys(spark):
    row = {"ledger_id": "L1", "title": "A b!", "year": "2001", "activity_type": "", "venue": " V ", "origin": "cv:S1", "source_url": "u"}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    c = {k: F.col(k) for k in row}
    ns = str(uuid.NAMESPACE_URL)
    got = df.select(ar.listed_key(c), ar.collected_key(c), ar.key_id(ar.listed_key(c), F.lit(2), ns), ar.reading_key(c), ar.pseudonym(F.col("ledger_id"), b"key"), ar.pseudonym(F.col("ledger_id"), b"k" * 99)).first()
    key = "\x1f".join(["L1", "S1", "ab", "2001", "", "V"])
    assert got[0] == key and got[1] == "\x1f".join(["L1", "u", "ab", "2001", "other", "V", "cv:S1"]) and got[2] == str(uuid.uuid5(uuid.NAMESPACE_URL, key + "\x1f2"))
    assert got[3] == hashlib.sha256("\x1f".join(["S1", "2001", "", "a b!", "v"]).encode()).hexdigest()[:16]
    assert [got[4], got[5]] == ["ps" + hmac.new(k, b"L1", hashlib.sha256).hexdigest()[:32] for k in (b"key", b"k" * 99)]


def test_marks(spark):
    assert each(spark, ar.rule_of, ["E2 same", "X1+E3", "E5 x", "", None]) == ["E2", "X1+E3", None, None, None]
    assert each(spark, ar.stratum_of, ["E1", " X1+E2 ", "manual", None]) == ["E1", "X1+E2", "uncoded", "uncoded"]
    note = "x; merged A; merged B; identity=k:1; merge_evidence=E1 same; rule=E1; merged C; merge_evidence=m; merged D"
    got = each(spark, ar.merge_marks, [note, "rule=E1", None])
    assert [[tuple(m) for m in x] for x in got] == [[("A", "E1 same", "E1"), ("B", "E1 same", "E1"), ("C", "m", ""), ("D", "", "")], [], []]


def test_labels(spark):
    assert each(spark, ar.short_name, ["A (b) · c", "B — d", "(x)"]) == ["A", "B", "(x)"]
    assert each(spark, lambda c: ar.generation_label(c.cast("int")), ["1999", "2003", None]) == ["1995–1999", "2000–2004", "undated"]
    assert each(spark, ar.keywords, ["Dev (e.g., Web, Game),  XR ,, a，b", "", None]) == [["Dev (e.g., Web, Game)", "XR", "a", "b"], [], []]
    assert each(spark, lambda c: ar.needle_tags(c, [("Seo", "s"), ("Ber", "b")], fallback="other"), ["Seo Ber", "Rome", " ", None]) == [["s", "b"], ["other"], [], []]
    assert each(spark, lambda c: ar.family_of(c, [("AB", "ab")], [("C", "cc")]), ["ABX-2001", "C-2001", "D-2001", None]) == ["ab", "cc", "D", ""]
    assert each(spark, lambda c: ar.ring_of(c, [("A", "f")]), ["A", "A-1", "AB"]) == ["f", "f", "AB"]
    assert each(spark, lambda c: ar.number_text(c.cast("double")), ["0.370", "-0.001", "12", "0.5", "100.0"]) == ["0.37", "0", "12", "0.5", "100"]
    assert each(spark, lambda c: ar.half_up(c.cast("double")), ["2.5", "0.49"]) == [3, 0]


def test_credits(spark):
    assert each(spark, ar.latin_personal_form, ["LEE, Ann", "Ann Lee (KR)", "Ann Lee (안리)", "a, b, c", None]) == ["Ann LEE", "Ann Lee", "Ann Lee (안리)", "a, b, c", ""]
    got = each(spark, ar.credit, ["Team X (김하늘)", "김하늘 (Sky)", "Pair (A B, C D)", "A & B", "Ann Lee", None])
    assert [tuple(g) for g in got] == [("김하늘", "", ["Team X"], "individual"), ("김하늘", "", ["Sky"], "individual"), ("", "Pair", ["A B", "C D"], "group"), ("", "A & B", [], "group"), ("", "Ann Lee", [], "individual"), ("", "", [], "individual")]
    assert each(spark, ar.credit_members, ["Pair (A B, C D)", "A & B", "Ann Lee"]) == [["A B", "C D"], ["A", "B"], []]
    assert each(spark, ar.noted_members, ["a; members=김하늘 | Ann  Lee,x; b", None]) == [["김하늘", "Ann Lee", "x"], []]
