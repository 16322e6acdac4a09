"""Visually identical text with different characters.

Cells that may be affected are exploded to positioned code points. Broadcast
tables of fixed size, derived from the Unicode tables of Python, from the list of
look-alike letters below and from the public Unicode confusables that ship with
Spark's ICU, decompose them. Combining marks are ordered by class, each base is
recomposed with its marks, and the strings are rebuilt. One shuffle, by cell.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters they look like.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ε": "e", "τ": "t", "ω": "w", "ϲ": "c", "ϳ": "j",
}
#: Compatibility kinds that look like the plain character (superscripts, circled and the like do not).
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Scripts whose letters stand beside Latin ones without posing as them, or run the other way.
OWN_LOOK = ("LATIN", "CJK", "HANGUL", "KATAKANA", "HIRAGANA", "HALFWIDTH", "FULLWIDTH", "BOPOMOFO", "YI ", "KANGXI", "ARABIC", "HEBREW")
#: Ranges scanned for decompositions: all of Unicode's planes that hold any.
LAST_CODE_POINT = 0x2FA1F
BETWEEN_WORDS = r"\s\p{Z},:;，：；()（）/|、"
WORD = rf"[^{BETWEEN_WORDS}]+|[{BETWEEN_WORDS}]"
LATIN = r"[A-Za-z\x{C0}-\x{24F}\x{FF21}-\x{FF5A}]"
#: Most cells hold nothing else, so the longer pattern looks at the rest only.
NOT_COMMON = r"[^\x00-\x7F\x{AC00}-\x{D7A3}]"
#: Characters between two ranges of the pattern that are let through with them; the operator leaves them as they are.
GAP = 24
S_BASE, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7


def _decomposed(ch: str) -> str:
    """Full decomposition of the kinds that do not change what the eye sees."""
    d = unicodedata.decomposition(ch)
    cat = unicodedata.category(ch)
    if cat == "Zs" and ch != " ":
        return " "
    if cat in ("Zl", "Zp") or not d or 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch
    kind, _, rest = d.partition(" ")
    if kind[0] == "<":
        # the non-breaking hyphen is one dash among others
        if kind not in SAME_LOOK and not 0xFB00 <= ord(ch) <= 0xFB06 or (kind, cat) == ("<noBreak>", "Pd"):
            return ch
        codes = rest
    else:
        codes = d
    return "".join(_decomposed(chr(int(x, 16))) for x in codes.split())


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """The letters of other scripts that look like one Latin letter: the list above, then the confusables ICU knows."""
    letters = [chr(c) for c in range(0x370, 0x20000) if unicodedata.category(chr(c))[0] == "L" and _decomposed(chr(c)) == chr(c)]
    letters = [ch for ch in letters if not unicodedata.name(ch, "CJK").startswith(OWN_LOOK)]
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    shapes: dict[str, list[str]] = {}
    for ch, shape in zip(latin, icu.getSkeleton("\n".join(latin)).split("\n")):
        shapes.setdefault(shape, []).append(ch)
    out = {}
    for ch, shape in zip(letters, icu.getSkeleton("\n".join(letters)).split("\n")):
        if shape in shapes:
            out[ch] = next((x for x in shapes[shape] if x.isupper() == ch.isupper()), shapes[shape][0])
    return out | LOOK_ALIKE


def character_map(look: dict[str, str] | None = None) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(character, when, [(code point, combining class)]): what each character becomes.

    ``when``: always; mixed - only in a word that also has Latin letters; text -
    only in a word without pictographs (their joiners and selectors are seen).
    """
    look = LOOK_ALIKE if look is None else look
    out = []
    for cp in range(0x80, LAST_CODE_POINT + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        if ch in look:
            out.append((ch, "mixed", [(ord(look[ch]), 0)]))
        elif unicodedata.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp == 0x034F:
            out.append((ch, "text", []))
        else:
            to = _decomposed(ch)
            if to != ch or unicodedata.combining(ch):
                out.append((ch, "always", [(ord(x), unicodedata.combining(x)) for x in to]))
    return out


class Plain:
    """The same for one string in Python: for operators that hold their strings there already."""

    def __init__(self, look: dict[str, str] | None = None):
        self.look = LOOK_ALIKE if look is None else look
        self.same = {ch: "".join(chr(c) for c, _ in to) for ch, _, to in character_map(self.look)}

    def __call__(self, s: str) -> str:
        if s.isascii():
            return s
        out = []
        for w in re.split(r"([\s,:;，：；()（）/|、]+)", s):
            mixed = any(ch in self.look for ch in w) and re.search("[A-Za-zÀ-ɏ]", w)
            out.append("".join(self.same[ch] if ch in self.same and (mixed or ch not in self.look) else ch for ch in w))
        return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=1)
def composition_pairs() -> dict[int, int]:
    """first << 21 | second -> composed, for the canonical pairs outside Hangul."""
    out = {}
    for cp in range(0xC0, LAST_CODE_POINT + 1):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            out[int(d[0], 16) << 21 | int(d[1], 16)] = cp
    return out


def spacing_seconds() -> list[int]:
    """Second characters of compositions that are no combining marks by class, as in several Indic scripts."""
    return sorted({s for s in (k & 0x1FFFFF for k in composition_pairs()) if not unicodedata.combining(chr(s))})


def _class(code_points: set[int], gap: int = GAP) -> str:
    """A regular-expression class of the code points, short gaps filled."""
    ranges: list[list[int]] = []
    for c in sorted(code_points):
        near = ranges and c - ranges[-1][1] <= gap and not ranges[-1][1] < 0xAC00 <= c
        if near:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def may_differ(look: dict[str, str], table: list[tuple[str, str, list[tuple[int, int]]]]) -> str:
    """The pattern of cells that may change: every character that does not come out as itself, every part of a composition, and mixed words.

    A composed letter is taken apart and put together again; it changes only beside
    a mark, which the pattern holds.
    """
    back = lambda to: unicodedata.normalize("NFC", "".join(chr(c) for c, _ in to))
    alone = {ord(ch) for ch, when, to in table if when != "mixed" and (back(to) != ch or unicodedata.combining(ch))} | set(spacing_seconds()) | set(range(0x1100, 0x1200))
    foreign = _class({ord(ch) for ch in look})
    inside = r"[^\s\p{Z},:;()/]*"
    return rf"{_class(alone)}|{LATIN}{inside}{foreign}|{foreign}{inside}{LATIN}"


def normalised_cells(cells: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, text, plain): the cells whose ``plain`` form differs from their text.

    ``keys`` name a cell uniquely. Null and empty cells never differ; cells that
    are plain already give no row. Other columns are ignored.
    """
    spark = cells.sparkSession
    cell = F.struct(*[F.col(k) for k in keys])
    look = look_alikes(spark)
    entries = character_map(look)
    foreign = _class({ord(ch) for ch in look})
    dirty = cells.select(cell.alias("cell"), F.col(text).alias("text")).filter(F.col("text").rlike(NOT_COMMON)).filter(F.col("text").rlike(may_differ(look, entries)))
    words = dirty.select("cell", "text", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w", "word"))
    # the text itself travels with the first point only, so that a long one is not multiplied
    words = words.select("cell", F.when(F.col("w") == 0, F.col("text")).alias("text"), "w", "word", (F.col("word").rlike(LATIN) & F.col("word").rlike(foreign)).alias("mixed"), F.col("word").rlike(r"\p{So}").alias("pict"))
    points = words.select("cell", "text", "w", "mixed", "pict", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("c", "ch"))
    table = F.broadcast(spark.createDataFrame(entries, "ch string, `when` string, `to` array<struct<cp:int,ccc:int>>"))
    seen = points.withColumn("text", F.when(F.col("c") == 0, F.col("text"))).join(table, "ch", "left")
    applies = (F.col("when") == "always") | ((F.col("when") == "mixed") & F.col("mixed")) | ((F.col("when") == "text") & ~F.col("pict"))
    own = F.array(F.struct(F.ascii("ch").alias("cp"), F.lit(0).alias("ccc")))
    parts = seen.select("cell", "text", "w", "c", F.when(applies, F.col("to")).otherwise(own).alias("to"))
    # one position per resulting code point; a cell that loses all its characters keeps an empty one
    flat = parts.select("cell", "text", "w", "c", F.posexplode_outer("to").alias("k", "p")).select("cell", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("text")).alias("text"), "w", "c", "k", F.col("p.cp").alias("cp"), F.col("p.ccc").alias("ccc"))
    place = Window.partitionBy("cell").orderBy("w", "c", "k")
    # a vowel or final jamo belongs to the Hangul right before it; elsewhere it is a base of its own
    after = F.lag("cp").over(place)
    hangul = after.between(L_BASE, 0x1112) | after.between(V_BASE, 0x1175) | after.between(S_BASE, 0xD7A3)
    spacing = F.coalesce(F.lag("ccc").over(place) == 0, F.lit(False)) & F.col("cp").isin(*spacing_seconds())
    joins_on = (F.col("ccc") > 0) | spacing | (F.coalesce(hangul, F.lit(False)) & (F.col("cp").between(V_BASE, 0x1175) | F.col("cp").between(T_BASE + 1, 0x11C2)))
    based = flat.withColumn("opens", F.when(joins_on, 0).otherwise(1)).withColumn("base", F.sum("opens").over(place))
    cluster = based.groupBy("cell", "base").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("ccc", "w", "c", "k", "cp"))).alias("points"))
    # a stable sort by class puts the base, class 0, first; jamo keep their order
    points = F.filter("points", lambda p: p["cp"].isNotNull())
    composed = cluster.select("cell", "base", "text", _composed(points).alias("codes"))
    rebuilt = composed.groupBy("cell").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("base", "codes"))).alias("all"))
    hexed = F.transform(F.flatten(F.transform("all", lambda s: s["codes"])), lambda c: F.lpad(F.hex(c), 8, "0"))
    plain = F.decode(F.unhex(F.array_join(hexed, "")), "UTF-32")
    return rebuilt.select("cell.*", "text", plain.alias("plain")).filter(F.col("plain") != F.col("text"))


def _composed(points: F.Column) -> F.Column:
    """Canonical composition of one base and its marks (code points in class order).

    A mark composes with the base unless a mark left in between has its class or a
    higher one.
    """
    pairs = F.map_from_arrays(F.lit(list(composition_pairs())), F.lit(list(composition_pairs().values())))

    def step(acc: F.Column, p: F.Column) -> F.Column:
        st, c = acc["st"], p["cp"]
        lv = F.when(st.between(L_BASE, 0x1112) & c.between(V_BASE, 0x1175), ((st - L_BASE) * 21 + (c - V_BASE)) * 28 + S_BASE)
        lvt = F.when(st.between(S_BASE, 0xD7A3) & ((st - S_BASE) % 28 == 0) & c.between(T_BASE + 1, 0x11C2), st + c - T_BASE)
        mark = F.when(c >= 0x300, F.element_at(pairs, F.shiftleft(st.cast("long"), 21).bitwiseOR(c.cast("long"))))
        free = (acc["last"] < 0) | (acc["last"] < p["ccc"])
        new = F.when(st.isNotNull() & free, F.coalesce(lv, lvt, mark)).cast("int")
        state = lambda s, rest, last: F.struct(s.alias("st"), rest.alias("rest"), last.alias("last"))
        return F.when(st.isNull(), state(c, acc["rest"], acc["last"])).when(new.isNotNull(), state(new, acc["rest"], acc["last"])).otherwise(state(st, F.concat(acc["rest"], F.array(c)), p["ccc"]))

    start = F.struct(F.lit(None).cast("int").alias("st"), F.array().cast("array<int>").alias("rest"), F.lit(-1).alias("last"))
    folded = F.aggregate(points, start, step, lambda acc: F.when(acc["st"].isNull(), acc["rest"]).otherwise(F.concat(F.array(acc["st"]), acc["rest"])))
    return F.when(F.size(points) > 1, folded).otherwise(F.transform(points, lambda p: p["cp"]))


def archive_cells(artists: DataFrame, activities: DataFrame) -> DataFrame:
    """The text cells of both tables as (src_table, row_id, field, text)."""
    a = artists.select(F.lit("artists").alias("src_table"), F.col("ledger_id").alias("row_id"), F.lit("name_ko").alias("field"), F.col("name_ko").alias("text"))
    b = activities.select(F.lit("activities").alias("src_table"), F.col("activity_id").alias("row_id"), F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("venue").alias("field"), F.col("venue").alias("text")))).alias("f")).select("src_table", "row_id", "f.field", "f.text")
    return a.unionByName(b)


def lookalike_cells(artists: DataFrame, activities: DataFrame) -> DataFrame:
    return normalised_cells(archive_cells(artists, activities), ["src_table", "row_id", "field"], "text")
