import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from kinweave.sources import extraction, ledger, registry, robots, snapshots, texts

from .conftest import rows


def test_csv_tables_round_trip(spark, tmp_path):
    led = ledger.Ledger(spark, str(tmp_path))
    assert led.read("artists").count() == 0 and led.read("artists").columns[0] == "ledger_id"
    t = spark.createDataFrame([("a", 'x "q", y', "line\nbreak")], "ledger_id string, name_en string, aliases string")
    cols = ledger.schema_of("artists").fieldNames()
    full = t.select(*[F.col(c) if c in t.columns else F.lit("").alias(c) for c in cols])
    assert led.write("artists", full, "t1", dt.date(2026, 1, 1)) is None
    assert rows(led.read("artists"), "ledger_id", "name_en", "aliases") == [("a", 'x "q", y', "line\nbreak")]
    assert led.write("artists", full, "t2", dt.date(2026, 1, 2)).endswith("2026-01-02.t2")
    assert led.write("artists", full, "t3", dt.date(2026, 1, 9)) is not None
    assert led.prune_backups(3, dt.date(2026, 1, 10)) == ["artists.2026-01-02.t2"]
    assert dict(rows(led.counts()))["artists"] == 1


def test_hidden_rows_leave_every_table(spark):
    a = spark.createDataFrame([("1", "HIDDEN_BY_REQUEST"), ("2", None)], "ledger_id string, status string")
    c = spark.createDataFrame([("1", 1), ("2", 2), (None, 3)], "ledger_id string, x int")
    assert rows(ledger.without(c, ledger.hidden_ids(a), "ledger_id"), "x") == [(2,), (3,)]


def test_decoding_and_html(spark):
    ko = "한글 문서"
    assert texts.decode_bytes(ko.encode("utf-8")) == ko and texts.decode_bytes(ko.encode("cp949")) == ko
    assert texts.decode_bytes(ko.encode("utf-16")) == ko
    assert texts.decode_bytes(b'<meta charset="euc-kr">' + ko.encode("cp949")).endswith(ko)
    assert texts.visible_text("<p>a <b>b</b></p><script>x</script><li>c&amp;d") == "a b\nc&d"
    assert texts.codec_of("KS_C_5601-1987") == "cp949" and texts.codec_of("nonsense") is None


def test_declared_codecs_and_readable_text(spark):
    assert texts.decode_bytes(b"caf\xe9 \xff", "utf-8") == "caf\ufffd \ufffd" and texts.decode_bytes("é".encode("cp1252"), "latin1") == "é"
    assert texts.codec_of("iso-ir-149") == "cp949" and texts.codec_of("MS949") == "cp949" and texts.codec_of("UTF8MB4") == "utf-8" and texts.codec_of("") is None
    df = spark.createDataFrame([("가나다 abc " * 40,), ("short",), ("%&/(" * 100,), (None,)], "c string")
    assert [r[0] for r in df.select(texts.looks_garbled(F.col("c"))).collect()] == [False, True, True, None]
    page = "<!-- <p>no</p> --><STYLE>p{}</STYLE><h1>Title</h1>a<br/>b &lt;c&gt; <i>d</i><script>if (a<b) x()</script><td>e"
    assert texts.visible_text(page) == "Title\na\nb <c> d\ne"


def test_a_table_replaced_twice_a_day(spark, tmp_path):
    led = ledger.Ledger(spark, str(tmp_path))
    full = spark.createDataFrame([("a",)], "ledger_id string").select(*[F.col(c) if c == "ledger_id" else F.lit("x").alias(c) for c in ledger.schema_of("scope").fieldNames()])
    day = dt.date(2026, 1, 1)
    assert led.write("scope", full, "t", day) is None and led.write("scope", full, "t", day).endswith("scope.2026-01-01.t")
    assert led.write("scope", full.unionByName(full), "t", day) is None and led.read("scope").count() == 2
    assert not list(tmp_path.glob(".scope*"))


def test_bodies_by_kind(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p></w:p>")
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.html").write_bytes("<p>가</p>".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in texts.read_bodies(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "One & two", "b.html": "가", "c.pdf": ""}


def test_one_bad_entry_rejects_the_document(spark):
    ok = '{"activities":[{"title":"A","year":2001,"activity_type":"solo"}]}'
    bad = ['{"activities":[{"title":"A","activity_type":"solo","more":1}]}', '{"activities":[{"title":"","activity_type":"solo"}]}', '{"activities":[{"title":"B","activity_type":"odd"}]}', "no json", None, "{}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([ok, *bad])], "i int, raw string")
    good, rejected = extraction.parse_extractions(df, "i", "raw", ["solo"])
    assert rows(good, "doc", "pos", "title", "year") == [(0, 0, "A", 2001)]
    assert rows(rejected) == [(i,) for i in range(1, 7)]


def test_tolerant_classes(spark):
    df = spark.createDataFrame([('["a","b"]',), ('{"a":true,"b":false}',), ("a, b",), (None,)], "c string")
    assert [sorted(r[0] or []) for r in df.select(extraction.classes_of(F.col("c"))).collect()] == [["a", "b"], ["a"], ["a", "b"], []]


def test_robots_longest_match(spark):
    txt = "User-agent: *\nDisallow: /\n\nUser-agent: kin\nDisallow: /private\nAllow: /private/open$\nDisallow: /*.pdf\nDisallow:\n"
    t = robots.rules_table(spark, {"h": txt}, "kin")
    u = spark.createDataFrame([("h", p) for p in ("/", "/private", "/private/open", "/private/openx", "/a/b.pdf")] + [("none", "/x")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in robots.verdicts(u, "host", "path", t).collect()}
    assert got == {("h", "/"): True, ("h", "/private"): False, ("h", "/private/open"): True, ("h", "/private/openx"): False, ("h", "/a/b.pdf"): False, ("none", "/x"): True}
    assert robots.parse_rules(txt, "other") == [(False, "/")]


def test_snapshots_hold_each_body_once(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([("u1", dt.datetime(2026, 1, 1), 200, "t", b"x"), ("u2", dt.datetime(2026, 1, 1), 200, "t", b"x")], snapshots.FETCH)
    two = spark.createDataFrame([("u1", dt.datetime(2026, 1, 2), 200, "t", b"y"), ("u2", dt.datetime(2026, 1, 2), 500, "t", b"z")], snapshots.FETCH)
    snapshots.append(spark, root, one)
    before = spark.createDataFrame(snapshots.latest(spark, root).collect(), snapshots.latest(spark, root).schema)
    snapshots.append(spark, root, two)
    assert snapshots.bodies(spark, root).count() == 3
    assert rows(snapshots.changed(before, snapshots.latest(spark, root))) == [("u1", "changed")]


def test_frame_registry(spark, tmp_path):
    p = tmp_path / "f.toml"
    p.write_text('[[frames]]\ncode="AB"\nroster_count=3\n[frames.eligibility]\ndecision="included"\n[frames.roster_size_declared]\n2020=5\n')
    r = registry.frames(spark, registry.load(str(p))).first()
    assert r["code"] == "AB" and r["declared"] == {"2020": 5}
    try:
        registry.frames(spark, {"frames": [{"code": "AB"}]})
        raise AssertionError("a programme without a decision passed")
    except ValueError:
        pass
