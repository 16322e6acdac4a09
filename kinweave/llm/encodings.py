"""Garbled text from wrong character encodings.

For every pair (true encoding, encoding it was read with) the garbled sequence
of each assigned character is computed beforehand. Multi-pattern automata find
them; only matched spans are replaced, so correct text around them stays. Passes
repeat until nothing matches, which undoes garbling of any depth: every pass
shortens the text, so they end. Double-byte codes, whose garbled pairs also occur
by chance, are recognised by runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Encodings UTF-8 bytes are read with by mistake, in order of preference.
READ_AS = ("cp1252", "latin-1", "mac_roman")
#: Further ones, whose garbled letters look more like correct text: so many telling spans are needed.
ALSO_READ_AS = ("cp1250", "cp1251", "cp437", "koi8-r")
PROOFS = 3
#: Double-byte codes UTF-8 bytes are read with; beyond the first only runs that come out as Hangul count.
DOUBLE_READ_AS = ("cp949", "gb18030", "shift_jis", "big5")
LOST = "�"
HIGH = re.compile("[\u00a0-þŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™\u0080-\u009f]{2,}")
IDEOGRAPH = re.compile("[\u4e00-\u9fff\uf900-\ufaff]")
HANGUL = re.compile("[가-힣]")
#: Punctuation of the Korean double-byte code.
SIGNS = frozenset("、。·‥…¨〃―∥～‘’“”〔〕〈〉《》「」『』【】±×÷°′″℃☆★○●◎◇◆□■△▲▽▼→←↑↓")
NON_ASCII = re.compile("[^\x00-\x7f]{2,}")


def _read(data: bytes, encoding: str) -> str:
    """Bytes as ``encoding`` shows them; bytes it leaves undefined become controls."""
    return "".join(_SEEN[encoding][b] for b in data)


def _seen_as(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_SEEN = {e: _seen_as(e) for e in (*READ_AS, *ALSO_READ_AS)}


def _syllables_of_latin() -> dict[str, str]:
    """The Hangul syllable that the UTF-8 bytes of a Latin letter or sign show as a Korean double byte."""
    out = {}
    for cp in range(0xA0, 0x250):
        try:
            seen = chr(cp).encode("utf-8").decode("cp949")
        except UnicodeDecodeError:
            continue
        if HANGUL.fullmatch(seen):
            out[seen] = chr(cp)
    return out


LATIN_OF = _syllables_of_latin()
_SYLLABLES = "[" + "".join(sorted(LATIN_OF)) + "]"
BESIDE_LATIN = re.compile(f"(?<=[A-Za-z]){_SYLLABLES}+|{_SYLLABLES}+(?=[A-Za-z])")
#: Texts of ASCII, Hangul and ordinary quotes and dashes alone cannot be garbled by any of the single-byte pairs.
SEEN_SINGLE = r"[^\x00-\x7F\x{AC00}-\x{D7A3}\x{2018}-\x{201D}\x{2013}\x{2014}]"
#: Nor by a double-byte pair, if no such syllable touches a Latin letter; the short pattern spares most texts the long one.
TOUCHES_LATIN = r"[A-Za-z][\x{AC00}-\x{D7A3}]|[\x{AC00}-\x{D7A3}][A-Za-z]"
SEEN_DOUBLE = f"[A-Za-z]{_SYLLABLES}|{_SYLLABLES}[A-Za-z]"


def _bytes_of(s: str) -> bytes | None:
    """Inverse of reading as cp1252 or latin-1."""
    out = bytearray()
    for ch in s:
        if ord(ch) < 256:
            out.append(ord(ch))
        else:
            try:
                out += ch.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


@lru_cache(maxsize=len(_SEEN))
def automaton(read_as: str) -> ahocorasick.Automaton:
    """All garbled sequences of one pair; the value is (length, character, whether it is telling alone).

    Two characters of which the second is a quote, dash or other sign of typography
    may stand together in correct text, so such a match needs a telling one beside it.
    """
    a = ahocorasick.Automaton()
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        seen = _read(ch.encode("utf-8"), read_as)
        if read_as in ALSO_READ_AS:
            telling = len(seen) > 2 or not seen[1].isalpha()
        else:
            telling = len(seen) > 2 or (seen[0] == "√" if read_as == "mac_roman" else "\u0080" <= seen[1] <= "\u00bf")
        a.add_word(seen, (len(seen), ch, telling))
    a.make_automaton()
    return a


def _matches(text: str, read_as: str) -> tuple[int, list]:
    """Characters covered by the pair's garbled sequences (0 without enough telling ones), and the matches."""
    found = list(automaton(read_as).iter_long(text))
    proofs = sum(t for _, (_, _, t) in found)
    return (sum(n for _, (n, _, _) in found), found) if proofs >= (PROOFS if read_as in ALSO_READ_AS else 1) else (0, [])


def _replaced(text: str, found: list) -> str:
    out, at = [], 0
    for end, (n, ch, _) in found:
        out.append(text[at : end - n + 1])
        out.append(ch)
        at = end + 1
    return "".join([*out, text[at:]])


def _as_double_bytes(run: str) -> str | None:
    """The run re-read as Korean double bytes, if it is wholly syllables and the code's signs of punctuation."""
    data = _bytes_of(run)
    if data is None:
        return None
    try:
        s = data.decode("cp949")
    except UnicodeDecodeError:
        return None
    whole = len(s) * 2 == len(data) and all(0xAC00 <= ord(c) <= 0xD7A3 or c in SIGNS for c in s)
    return s if whole else None


def _as_hangul(run: str) -> str | None:
    """As ``_as_double_bytes``, for runs of at least half syllables."""
    s = _as_double_bytes(run)
    return s if s and sum(0xAC00 <= ord(c) <= 0xD7A3 for c in s) * 2 >= len(s) else None


def _is_utf8(run: str) -> bool:
    data = _bytes_of(run)
    try:
        return data is not None and bool(data.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _double_bytes(text: str) -> int:
    """Characters in runs that are Korean double bytes and no garbled UTF-8.

    Short runs may be chance, so one run of three syllables or two runs of two are needed.
    """
    proofs = [len(r) for r in HIGH.findall(text) if len(r) >= 4 and not _is_utf8(r) and _as_hangul(r)]
    return sum(proofs) if len(proofs) > 1 or max(proofs, default=0) >= 6 else 0


def _double_read_restored(text: str) -> str:
    """UTF-8 bytes read as double bytes: runs that encode back to valid UTF-8."""
    if not IDEOGRAPH.search(text):
        return text

    def back(m: re.Match) -> str:
        if not IDEOGRAPH.search(m[0]):
            return m[0]
        for code in DOUBLE_READ_AS:
            try:
                got = m[0].encode(code).decode("utf-8")
            except UnicodeError:
                continue
            if code == DOUBLE_READ_AS[0] or len(got) > 1 and all(HANGUL.match(c) or c in SIGNS for c in got):
                return got
        return m[0]

    return NON_ASCII.sub(back, text)


def _latin_read_restored(text: str, proven: bool) -> str:
    """Latin letters whose UTF-8 bytes were read as Korean double bytes, as in Qui챕n.

    Such syllables also stand beside Latin letters in Korean, so no other Hangul
    may be there, and there must be two of them unless the text is proven garbled.
    """
    spans = BESIDE_LATIN.findall(text)
    if not spans or len(spans) < 2 and not proven or sum(map(len, spans)) < len(HANGUL.findall(text)):
        return text
    return BESIDE_LATIN.sub(lambda m: "".join(LATIN_OF[c] for c in m[0]), text)


def restored_text(text: str) -> str:
    """The text with garbled spans restored; equal to the input if none is found.

    Each pass applies the one pair that explains most characters, until none explains any.
    """
    was, text = text, _double_read_restored(text)
    while True:
        covered, found = max((_matches(text, enc) for enc in (*READ_AS, *ALSO_READ_AS)), key=lambda m: m[0])
        if _double_bytes(text) > covered:
            text = HIGH.sub(lambda m: _as_double_bytes(m[0]) or m[0], text)
        elif covered:
            text = _replaced(text, found)
        else:
            return _latin_read_restored(text, text != was)


CONTROL = re.compile("[\u0080-\u009f]")


def restored_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, restored, lost): the documents found garbled.

    ``restored`` is the whole text with its garbled spans replaced, or null where
    ``lost``: a replacement character, or a control left over by the restoration,
    shows that bytes are gone. Null and empty texts, and texts without garbled
    spans, give no row. No shuffle; texts are read whole.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, new, lost = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LOST in t:
                    ids.append(i), new.append(None), lost.append(True)
                    continue
                r = restored_text(t)
                if r != t:
                    gone = bool(CONTROL.search(r)) or LOST in r
                    ids.append(i), new.append(None if gone else r), lost.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(new, pa.string()), pa.array(lost, pa.bool_())], names=["doc_id", "restored", "lost"])

    t = F.col("text")
    return src.filter(t.rlike(SEEN_SINGLE) | (t.rlike(TOUCHES_LATIN) & t.rlike(SEEN_DOUBLE))).mapInArrow(run, f"doc_id {kind}, restored string, lost boolean")
