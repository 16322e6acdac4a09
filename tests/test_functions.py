import uuid

from pyspark.sql import functions as F

from kinweave.functions import language, split, text, urls
from kinweave.functions.dates import code_family, code_year, year_of

from .conftest import rows


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["x"] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_alias_cells(spark):
    got = each(spark, split.alias_values, [None, "", " , ", "a", "a,b", '"Lee, Yui"|유이', "“Nellofeld, M.”、\"Margaret \"\"Maggie\"\" Nellofeld\"", "x/y\nz\t", 'open "quote', '"a""b"', "a;;b"])
    assert got == [None, [], [], ["a"], ["a", "b"], ["Lee, Yui", "유이"], ["Nellofeld, M.", 'Margaret "Maggie" Nellofeld'], ["x", "y", "z"], ['open "quote'], ['a"b'], ["a", "b"]]


def test_venue_cells(spark):
    got = each(spark, split.venue_values, ["Room 24/7, Place", "A / B", "A // B→C", "K-Ann & Sons Hall - Town", '"A, x";"B"', '"A", "B, y"', "A|", "A, B (C)", "Hall\tX", "Ora+ Room、S 7/8", "End/"])
    assert got == [["Room 24/7, Place"], ["A", "B"], ["A", "B", "C"], ["K-Ann & Sons Hall - Town"], ["A, x", "B"], ["A", "B, y"], ["A"], ["A, B (C)"], ["Hall\tX"], ["Ora+ Room", "S 7/8"], ["End"]]


def test_packed_rows_with_odd_tables(spark):
    df = spark.createDataFrame([("1", "a|b|", "x"), ("2", None, "y"), ("3", "one", "z"), (None, "p|p", "q"), ("5", "v|" * 5000, "w")], "id string, cell string, pos string")
    got = split.packed_rows(df, "id", "cell", "t", "alias")
    assert rows(got.filter("row_id = '1'")) == [("t", "1", 1, "a"), ("t", "1", 2, "b")]
    assert got.filter("row_id IS NULL").count() == 2 and got.filter("row_id = '5'").count() == 5000
    assert split.packed_rows(df.limit(0), "id", "cell", "t", "venue").count() == 0
    assert got.schema["pos"].dataType.simpleString() == "int"


def test_text_keys(spark):
    assert each(spark, text.match_key, ["Ab-c 1!", "가 나", None, "…"]) == ["abc1", "가나", None, ""]
    assert each(spark, text.lang_of, ["abc", "가나다", "가나 ab", "123"]) == ["en", "ko", "mixed", ""]
    assert each(spark, text.norm_text, [" a​ b  c "]) == ["a b c"]
    assert each(spark, text.fold_width, ["Ｒｏｏｍ　１"]) == ["Room 1"]
    assert each(spark, text.romanise, ["김밥 x", "값"]) == ["gimbap x", "gap"]
    assert each(spark, text.title_base, ["Work No. 12"]) == ["workno"]
    assert each(spark, text.strip_titles, ["《A》 show", "《A》"]) == ["show", "《A》"]
    assert each(spark, text.tokenize, ["가나다 ab c"]) == [["가나다", "ab", "가나", "나다"]]
    assert each(spark, text.initials, ["Museum of Modern Art"]) == ["MMA"]
    assert each(spark, text.place_key, ["  (Town!) "]) == ["town"]
    assert each(spark, lambda c: text.note_value(c, "rule"), ["a=1; rule=E2 ;b", "rule", None]) == ["E2", "", None]
    assert each(spark, lambda c: text.is_subsequence(c, F.lit("museum of art")), ["moa", "xyz"]) == [True, False]


def test_skeletons_agree_across_spellings(spark):
    a, b = each(spark, text.skeleton, ["Jeong Cheol", "jung choll"])
    assert each(spark, text.skeleton, ["Geumho"]) == each(spark, text.skeleton, ["Kumho"]) and a[0] == b[0]


def test_uuid5_is_the_standard_one(spark):
    ns = uuid.NAMESPACE_URL
    names = ["a", "가나", "x" * 300]
    assert each(spark, lambda c: text.uuid5(c, str(ns)), names) == [str(uuid.uuid5(ns, n)) for n in names]


def test_pair_keys_and_titles(spark):
    df = spark.createDataFrame([("red sea", "sea red"), ("red sea", "blue hill")], "a string, b string")
    got = df.select(text.pair_key(F.col("a"), F.col("b")) == text.pair_key(F.col("b"), F.col("a")), text.titles_agree(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False)]


def test_years_and_codes(spark):
    assert each(spark, year_of, ["in 2017년", "12", None, "1899 2001"]) == [2017, None, None, 2001]
    assert each(spark, code_year, ["AB-2019", "AB", "AB-19"]) == [2019, None, None]
    assert each(spark, code_family, ["AB-2019", "AB"]) == ["AB", "AB"]


def test_urls(spark):
    assert each(spark, urls.domain_of, ["HTTPS://www.A.org:80/x", "b.net", None]) == ["a.org", "b.net", None]
    assert each(spark, urls.url_key, ["https://me.github.io/x/index.html?q", "https://www.a.org/me", "http://b.tistory.com/", "https://notgithub.io/x", None]) == ["me.github.io/x", "a.org", "b.tistory.com/", "notgithub.io", None]
    assert each(spark, urls.surt, ["https://www.a.org/x/Y?q=1"]) == ["org,a)/x/y"]
    assert each(spark, urls.detect_kind, ["http://a/b.PDF?x", "https://docs.google.com/document/d/1/edit", "http://a"]) == ["pdf", "gdoc", "web"]
    assert each(spark, urls.fetch_target, ["https://docs.google.com/document/d/1/edit"]) == ["https://docs.google.com/document/d/1/export?format=pdf"]
    targets = ["https://drive.google.com/file/d/A_1/view", "https://drive.google.com/open?id=B-2&x=1", "https://drive.google.com/x", "https://www.dropbox.com/s/q?dl=0", "https://dropbox.com/s/q", "https://a.org/cv"]
    assert each(spark, urls.fetch_target, targets) == ["https://drive.google.com/uc?export=download&id=A_1", "https://drive.google.com/uc?export=download&id=B-2", None, "https://www.dropbox.com/s/q?dl=1", "https://dropbox.com/s/q?dl=1", "https://a.org/cv"]
    assert each(spark, urls.detect_kind, ["https://drive.google.com/drive/folders/1", "https://drive.google.com/file/d/1", "https://docs.google.com/spreadsheets/d/1"]) == ["gdrive_folder", "gdrive_file", "gsheet"]
    assert each(spark, urls.link_type, ["https://m.facebook.com/a", "https://minaparkx.com", "https://vimeo.com/1", "https://github.com/a", "https://youtu.be/1"]) == ["social", "website", "video", "repository", "video"]


def test_text_rules_of_the_archive(spark):
    assert each(spark, text.match_key, ["STRASSE", "straße", "e\u0301"]) == ["strasse", "strasse", "é"]
    assert each(spark, text.norm_text, ["e\u0301\u00a0x", "\u1112\u1161\u11ab"]) == ["é x", "한"]
    assert each(spark, text.skeleton, ["Kookmin 2", "wonju", "xylem"]) == ["gugmin2", "onju", "gsylem"]
    df = spark.createDataFrame([("봄 그늘", "spring shade"), ("a b", "a b"), ("12", "red"), ("Red Sea 2", "red sea 1")], "a string, b string")
    assert [r[0] for r in df.select(text.titles_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


def test_language_plug_in(spark):
    lang = language.load("kinweave.functions.language:KoreanEnglish")
    assert set(lang.name_keys("김유환")) & set(lang.name_keys("Yuhwan Kim")) == {"kim/yuhwan"}
    assert lang.personal("김유환") and lang.personal("Ann Lee") and not lang.personal("Hall")
    assert each(spark, language.name_keys, [None, "", "Kim Yu-hwan"]) == [[], [], ["kim/yuhwan", "yuhwan/kim"]]
    assert each(spark, text.nfc, ["é", None]) == ["é", None]
