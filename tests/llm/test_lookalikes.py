import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.lookalikes import Plain, character_map, composition_pairs, look_alikes, may_differ, normalised_cells

from ..conftest import rows


def plain(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumnRenamed("i", "cell")
    return {r["cell"]: r["plain"] for r in normalised_cells(df, ["cell"], "t").collect()}


def test_cells_that_only_look_plain(spark):
    cases = {
        "\uff32\uff4f\uff4f\uff4d": "Room", "a\u200bb": "ab", "A\u00a0B": "A B", "\u1112\u1161\u11ab\u1100\u1173\u11af": "\ud55c\uae00", "e\u0301": "\u00e9", "Reumb\u0456to": "Reumbito", "\u039a-Ann": "K-Ann", "\ufb01lm": "film",
        "\ubbf8\ub124\uff0c": "\ubbf8\ub124,", "\u200b": "", "a\u0323\u0302": "\u1ead", "a\u0302\u0323": "\u1ead", "\u00adsoft": "soft", "\u3000wide": " wide", "\u1100\u1161\u11a8": "\uac01", "\u212b": "\u00c5",
    }
    assert plain(spark, cases) == {i: v for i, v in enumerate(cases.values())}


def test_plain_cells_give_no_row(spark):
    same = ["Φως: Tide", "Тишина", "光と影", "a\tb", "a  b", "“q” – ‘x’", "é", "각", "", None, "👩‍🎨 art", "½ ①", "、→"]
    assert plain(spark, same) == {}


def test_empty_table_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([("1", "ａ" * 50000, "x", "y")], "base string, t string, ch string, w string")
    assert rows(normalised_cells(df, ["base"], "t").select("base", "plain")) == [("1", "a" * 50000)]
    assert normalised_cells(df.limit(0), ["base"], "t").count() == 0


def test_tables_are_bounded(spark):
    assert len(character_map(look_alikes(spark))) < 10_000 and len(composition_pairs()) < 2000


def test_agrees_with_the_standard_composition(spark):
    marks = ["\u0300", "\u0301", "\u0323", "\u0302", "\u030c", "\u1161", "\u11a8"]
    texts: list[str] = []

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from(["a", "e", "o", "ᄀ", "가", "x", " ", "é", "ự", *marks]), min_size=1, max_size=8))
    def collect(s):
        texts.append(s)

    collect()
    got = plain(spark, texts)
    for i, t in enumerate(texts):
        assert got.get(i, t) == unicodedata.normalize("NFC", t), ascii(t)


def test_every_code_point_as_itself_and_decomposed(spark):
    assigned = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = list(dict.fromkeys(t for ch in assigned for t in (ch, unicodedata.normalize("NFD", ch))))
    got, want = plain(spark, texts), Plain(look_alikes(spark))
    assert [(t, got.get(i, t)) for i, t in enumerate(texts) if got.get(i, t) != want(t)] == []
    assert want("\uff76\uff9e") == "\u30ac" and want("\u30ab\u3099") == "\u30ac"


def test_the_filter_lets_every_change_through(spark):
    look = look_alikes(spark)
    table = character_map(look)
    want = Plain(look)
    texts = [t for ch, when, _ in table for t in ((f"ab{ch}",) if when == "mixed" else (ch, f"a{ch}\u0301", f"{ch}\u0323", f"\u00e9{ch}"))]
    df = spark.createDataFrame([(t,) for t in texts if want(t) != t], "t string")
    assert df.count() > 10_000 and df.filter(~df.t.rlike(may_differ(look, table))).count() == 0


def test_letters_of_further_scripts(spark):
    got = plain(spark, ["R\u0585om", "\u13aa\u13e2dio", "\ua4d0ar", "Caf\u0435\u0301", "non\u2011stop", "\u0561\u0580\u057f", "\u30ac\u30ab\u3099"])
    assert got == {0: "Room", 1: "APdio", 2: "Bar", 3: "Caf\u00e9", 6: "\u30ac\u30ac"}
