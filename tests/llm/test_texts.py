import hashlib
import random

import pytest

from kinweave.llm.bpe import Bpe, encoded, load
from kinweave.llm.encodings import restored_documents, restored_text
from kinweave.llm.leaks import Patterns, leaked_items, words_of

from ..conftest import rows

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HAS_VOCAB = __import__("os").path.exists(VOCAB)


def brute(b: Bpe, text: str) -> list[int]:
    """Lowest rank first, leftmost first, word by word."""
    out = []
    for w in b.pattern.findall(text):
        ids = [b.single[x] for x in w.encode()]
        while True:
            ranked = [(b.merge_of(x, y), i) for i, (x, y) in enumerate(zip(ids, ids[1:])) if b.merge_of(x, y) >= 0]
            if not ranked:
                break
            r, i = min(ranked)
            ids[i : i + 2] = [r]
        out += ids
    return out


@pytest.mark.skipif(not HAS_VOCAB, reason="no vocabulary")
def test_ids_against_brute_force_and_round_trip():
    b = load(VOCAB)
    random.seed(5)
    texts = ["", None, " ", "aaaaaaa  aaa\n\n x", "안녕하세요 세계", "<|endoftext|>", "it's 12345 👩‍🎨", "".join(random.choice("ab ") for _ in range(500)), "가" * 3000]
    got = b.encode(texts)
    assert got == [brute(b, t) if t else [] for t in texts]
    assert [b"".join(b.bytes_of[i] for i in ids).decode() for ids in got] == [t or "" for t in texts]
    assert len(got[5]) > 1


@pytest.mark.skipif(not HAS_VOCAB, reason="no vocabulary")
def test_one_row_per_document(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello", 0), (3, "hello", 0)], "doc_id bigint, text string, ids int")
    got = rows(encoded(df, "doc_id", "text", VOCAB))
    assert [(i, len(x)) for i, x in got] == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert encoded(df.limit(0), "doc_id", "text", VOCAB).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_leaks_of_twelve_words(spark):
    items = spark.createDataFrame([(1, ITEM, "t"), (2, "short text", "t"), (3, None, "t"), (4, "x " + " ".join(ITEM.split()[1:13]), "t")], "item_id bigint, text string, doc_id string")
    w = ITEM.split()
    docs = [(1, "A. " + ", ".join(x.upper() for x in w[2:14]) + "! end"), (2, " ".join(w[3:14])), (3, None), (4, ""), (5, "\n".join(w[1:13])), (6, " ".join(w) * 1), (7, "pad " * 20000 + ITEM), (7, ITEM)]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id bigint, text string, item_id int")
    got = rows(leaked_items(df, "doc_id", "text", items, "item_id", "text"))
    assert got == [(1, 1), (5, 1), (5, 4), (6, 1), (6, 4), (7, 1), (7, 1), (7, 4), (7, 4)]
    assert rows(leaked_items(df, "doc_id", "text", items, "item_id", "text", part_words=10)) == got
    assert leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_case_does_not_matter_where_it_changes_letters(spark):
    text = "die Straße am großen Fluss ist heute für alle Gäste der Stadt offen"
    items = spark.createDataFrame([("i", text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "X " + text.upper() + "!"), (2, text.title())], "doc_id bigint, text string")
    assert rows(leaked_items(docs, "doc_id", "text", items, "item_id", "text")) == [(1, "i"), (2, "i")]


@pytest.mark.parametrize("m,b", [(12, 3), (4, 2), (2, 3), (1, 1)])
def test_search_against_brute_force(m, b):
    random.seed(m)
    word = lambda: random.choice("abcd")
    items = [(i, " ".join(word() for _ in range(random.randrange(1, 20)))) for i in range(12)]
    p = Patterns(items, m, b)
    for _ in range(60):
        text = " ".join(word() for _ in range(random.randrange(0, 60)))
        w = words_of(text)
        runs = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
        want = {i for i, t in items for v in [words_of(t)] for k in range(len(v) - m + 1) if tuple(v[k : k + m]) in runs}
        assert p.search(text) == want


def sloppy(b: bytes) -> str:
    return "".join(chr(x) if x in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([x]).decode("cp1252") for x in b)


TEXTS = ["작곡가는 보기 드문 인내심으로 쓴다.", "L’été, “à côté” – où", "Über süße Öffnung, weiß", "NÃO “TOCAR” – São", "광 光と影 Φως Тишина — 3 × 4 m", "👩‍🎨 ✨ art – 5 €"]


@pytest.mark.parametrize("text", TEXTS)
def test_garbled_texts_come_back(text):
    u = text.encode("utf-8")
    for bad in (sloppy(u), u.decode("latin-1"), sloppy(sloppy(u).encode("utf-8")), u.decode("mac_roman")):
        assert restored_text(bad) == text
    assert restored_text("뒷벽을 마주하고 " + sloppy(u) + " é 안에서 ") == "뒷벽을 마주하고 " + text + " é 안에서 "


def test_korean_double_bytes_come_back():
    t = "작곡가는 보기 드문 인내심으로 기록한다."
    assert restored_text(t.encode("cp949").decode("latin-1")) == t


@pytest.mark.parametrize("text", [*TEXTS, "12 ± 2 coins, 5 °C, ¿Quién vive? £5 – or 6 €", "Fjord, Å, Ægir and Øre", "„Schnee“ – „Ä“", ""])
def test_correct_texts_stay(text):
    assert restored_text(text) == text


def test_documents_with_and_without_losses(spark):
    t = "Über süße Öffnung"
    bad = sloppy(t.encode())
    df = spark.createDataFrame([(1, bad, "x"), (2, t, "x"), (3, None, "x"), (4, "", "x"), (5, "K��che", "x"), (6, bad + "�", "x"), (7, (bad + " plain ") * 2000, "x")], "doc_id bigint, text string, lost string")
    got = {r["doc_id"]: (r["restored"], r["lost"]) for r in restored_documents(df, "doc_id", "text").collect()}
    assert got == {1: (t, False), 5: (None, True), 6: (None, True), 7: ((t + " plain ") * 2000, False)}
    assert hashlib.md5(got[1][0].encode()).hexdigest() and restored_documents(df.limit(0), "doc_id", "text").count() == 0


def test_garbling_of_any_depth_and_any_script():
    deep = text = "Grüße aus Köln, ça va – 안녕하세요 שלום สวัสดี 🇰🇷 नमस्ते"
    for _ in range(7):
        deep = sloppy(deep.encode())
    assert restored_text(deep) == text
    for enc in ("cp1250", "cp1251", "cp437", "koi8-r"):
        seen = [bytes([b]).decode(enc, "ignore") or chr(b) for b in range(256)]
        assert restored_text("".join(seen[b] for b in text.encode())) == text


def test_latin_letters_read_as_hangul():
    assert restored_text("쩔Qui챕n vive?") == "¿Quién vive?"
    assert restored_text("art체와 Web쩔이") == "art체와 Web쩔이" and restored_text("Vitamin챕") == "Vitamin챕"


def test_correct_text_of_further_scripts_stays():
    for text in ("Тишина и свет, «Рёбра» РС Рай Сын", "光と影 中文 東京", "ελληνικά Ωδή", "┬─┴ box ├──┤", "Říční žluťoučký kůň – Śląsk"):
        assert restored_text(text) == text
