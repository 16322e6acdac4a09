"""Variant spellings of names typed by people.

Every name of a row becomes canonical forms: Hangul is romanised, spellings of
the same sound are folded together, words for kinds of teams are set apart, and
order is undone. Forms are character n-gram vectors weighted by rarity, in a
hashed space of fixed size. Inside a block of equal attributes a sparse cosine
join with exact prefix filtering gives the pairs of forms and their cosine; those
from the threshold on, if a comparison of their parts confirms them, are links.
Rows that share a form or a published id are one node, and average linkage over
the cosines joins nodes to entities.

Average linkage runs in rounds: every pair of nodes that are each other's best
neighbours joins. That gives the same tree as joining the one best pair at a time,
and can be done in a task, for blocks that fit one, or in Spark, for larger ones,
with the same result: similarities are whole numbers, and ties go by id.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import FAMILIES, SAME_FAMILY
from ..functions.split import alias_values
from ..functions.text import CODAS, NUCLEI, ONSETS
from ..operators.joins import hot_keys, skew_left_join
from ..shipping import ship
from ..storage import Scratch
from .groups import match_groups
from .lookalikes import Plain, look_alikes
from .survivors import value_of

#: Cosine of two forms from which on they are compared part by part.
COSINE = 0.15
#: Average cosine from which on two clusters join.
LINKAGE = 0.1
#: Similarities are whole numbers of this unit, so that sums do not depend on order.
UNIT = 1_000_000
#: Dimensions of the n-gram space; n-grams are hashed, so their weights have a fixed size.
DIMENSIONS = 1 << 18
#: Rows of a block one task clusters; a larger block is clustered in Spark, with the same result.
TASK_ROWS = 20_000
#: Postings of one n-gram in a block joined in one cell; more are cut into cells.
CELL = 2000
#: Words for kinds of teams by kind, words that add nothing, and titles that make the next word a stage name.
TEAM_KINDS = {
    "studio": "studio std 스튜디오", "project": "project proj 프로젝트", "lab": "lab labs laboratory 랩 연구소", "company": "company co comp 컴퍼니", "collective": "collective coll 콜렉티브 컬렉티브",
    "group": "group grp 그룹", "ensemble": "ensemble ens 앙상블", "workshop": "workshop works wkshp 공방", "atelier": "atelier 아틀리에", "team": "team crew 팀", "orchestra": "orchestra orch 오케스트라", "band": "band 밴드", "duo": "duo 듀오", "union": "union 유니온",
}
KIND_OF = {w: k for k, ws in TEAM_KINDS.items() for w in ws.split()}
EMPTY_WORDS = set("the inc ltd llc limited corp ev gmbh 주식회사".split())
TITLES = set("dj vj mc".split())
#: Customary short forms of given names that are not made of letters of the long one in order.
SHORT_FORMS = {
    "alexander": "sasha alec lex xander", "alice": "allie", "andrew": "drew andy", "anne": "nan nancy annie", "antoinette": "toni nettie", "barbara": "babs barb", "catherine": "kitty kate cathy", "charles": "chuck charlie",
    "christopher": "kit chris topher", "dorothy": "dolly dot dottie", "edward": "ted ned teddy", "eleanor": "nell ellie nora", "elisabeth": "liz betty beth bess lisa elsa", "elizabeth": "liz betty beth bess lisa elsa", "florence": "flo flossie",
    "francis": "frank fran", "frances": "fanny fran frankie", "frederick": "fritz freddie", "george": "geordie", "gertrude": "trudy", "helen": "nell nellie lena", "henry": "hank harry hal", "isabella": "bella ella izzy", "jacob": "jake jakob",
    "james": "jim jimmy jamie", "johann": "hans hannes", "johannes": "hans hannes", "john": "jack johnny", "josef": "sepp beppo", "joseph": "joe jo", "katherine": "kitty kate kathy katie", "lawrence": "larry laurie", "leonard": "len lenny",
    "margaret": "peggy meg maggie greta daisy", "martha": "patty mattie", "mary": "polly molly mamie", "matilda": "tilly mattie", "michael": "mick mike mickey", "nicholas": "klaus colin nick", "patricia": "pat patty trish", "philippa": "pip pippa",
    "rebecca": "becky becca", "richard": "dick rick rich", "robert": "bob rob bobby", "rose": "rosie", "samuel": "sam sammy", "sarah": "sally sadie", "stephen": "steve steph", "susan": "sukie sue", "theodore": "ted theo teddy", "theresa": "tess tracy terry",
    "thomas": "tom tommy", "victoria": "vicky tori", "virginia": "ginny", "walter": "walt wat", "wilhelm": "willi helm", "william": "bill will billy liam",
}
_LONG_OF: dict[str, set[str]] = defaultdict(set)
for _long, _shorts in SHORT_FORMS.items():
    for _short in _shorts.split():
        _LONG_OF[_short].add(_long)
#: Spellings of one sound, replaced in order.
SPELLED = [("oo", "u"), ("you", "yo"), ("yeo", "yo"), ("ou", "o"), ("eo", "o"), ("eu", "u"), ("ae", "e"), ("ui", "i"), ("ch", "j"), ("ck", "k"), ("k", "g"), ("t", "d"), ("p", "b"), ("l", "r"), ("sh", "s"), ("ph", "b")]


def romanised(s: str) -> str:
    out = []
    for ch in s:
        k = ord(ch) - 0xAC00
        out.append(ONSETS[k // 588] + NUCLEI[k % 588 // 28] + CODAS[k % 28] if 0 <= k < 11172 else ch)
    return "".join(out)


def folded(s: str) -> str:
    """One spelling for the ways a sound is written; doubled letters once."""
    for a, b in SPELLED:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


FAMILY_OF = {w: ko for ko, ws in FAMILIES.items() for w in ws.split()}
HANGUL = re.compile("[가-힣]")
INITIALS = re.compile(r"^(?:[A-Za-z]\.-?){2,}$")
_BASE_PLAIN = Plain()


def _latin(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s.lower()) if ch.isalnum())


#: First letters that may stand for one another in romanised given names.
SAME_INITIAL = {"k": "g", "t": "d", "p": "b", "l": "r", "c": "j"}


def _korean(family: str, given: str) -> set[str]:
    """A family with a given name, and the pair's initial; of an initial alone only the latter."""
    first = SAME_INITIAL.get(given[:1], given[:1])
    return {f"K|{family}|{folded(given)}", f"I|{family}|{first}|full"} if len(given) > 1 else {f"I|{family}|{first}|only"}


def _single(core: str, whole: str, kinds: list[str], alias: bool, hangul: bool, titled: bool = False) -> set[str]:
    """A name of one part. An alias counts as it is written (a|); a name field so too (A|), and by its core with its kind (S|)."""
    if alias:
        return {f"a|{whole}"}
    written = {f"A|{whole}"}
    if titled:
        return written
    # a bare Latin core says too little beside another kind of team; the short name meets it as S
    return written | {f"S|{core}|{kinds[0] if kinds else ''}"} | ({f"A|{core}"} if hangul or not kinds else set())


def forms_of(value: str, alias: bool = False, plain: Plain = _BASE_PLAIN) -> set[str]:
    """Canonical forms of one name: K|family|given, I|family|initial|full or only, W|surname|given, S|core|kind, A|as written (a| in an alias)."""
    text = plain(value)
    s = re.sub(r'"[^"]*"', " ", text) if text.count('"') > 1 else text
    inverted = re.match(r"\s*([^,]+),\s*(.+)$", s)
    words = [w for w in re.split(r"[\s,]+", s.strip()) if w]
    bare_words = [re.sub(r"[^\w]", "", w.lower()) for w in words]
    titled = len(words) > 1 and bare_words[0] in TITLES
    kinds = [KIND_OF[w] for w in bare_words if w in KIND_OF]
    spoken = [w for w, b in zip(words, bare_words) if b not in EMPTY_WORDS] or words
    core = [w for w, b in zip(words, bare_words) if b not in KIND_OF and b not in EMPTY_WORDS] or words
    team = bool(kinds) or titled
    out: set[str] = set()
    if HANGUL.search(s):
        ko = ["".join(HANGUL.findall(w)) for w in core]
        ko = [w for w in ko if w]
        if not ko:
            return out
        joined = "".join(ko)
        if not team:
            fam = SAME_FAMILY.get(joined[0], joined[0])
            if len(ko) == 2 and SAME_FAMILY.get(ko[1], ko[1]) in FAMILIES and len(ko[0]) > 1:
                out |= _korean(SAME_FAMILY.get(ko[1], ko[1]), romanised(ko[0]))
            elif fam in FAMILIES and 2 <= len(joined) <= 4:
                out |= _korean(fam, romanised(joined[1:]))
        if out and not alias:
            # a personal name may be misspelt as K only
            return out | {f"A|{romanised(joined)}"}
        return out | _single(romanised(joined), romanised("".join(HANGUL.findall("".join(spoken)))), kinds, alias, True, titled)
    # initials written together count as their first letter
    core = [w[0] + "." if INITIALS.match(w) else w for w in core]
    pairs = [(w, b) for w, b in zip(core, map(_latin, core)) if b]
    if not pairs:
        return out
    if len(pairs) == 1 or team:
        return _single("".join(b for _, b in pairs), "".join(map(_latin, spoken)), kinds, alias, False, titled)
    names = [b for _, b in pairs]
    for at in dict.fromkeys((0, len(names) - 1)) if not inverted else (0,):
        if names[at] in FAMILY_OF and len(pairs) <= 4:
            rest = names[1:] if at == 0 else names[:-1]
            out |= _korean(FAMILY_OF[names[at]], "".join(rest) if max(map(len, rest)) > 1 else rest[0])
    if out:
        return out
    sur, given = (names[0], names[1:]) if inverted else (names[-1], names[:-1])
    long = [g for g in given if len(g) > 1]
    return {f"W|{folded(sur)}|{long[0] if long else given[0] + '.'}"}


def _family_initial(form: str) -> tuple[str, bool] | None:
    """(family|initial, whether the name has the whole given name) of a Korean name."""
    if form[0] != "I":
        return None
    _, family, initial, whole = form.split("|")
    return f"{family}|{initial}", whole == "full"


def row_forms(ko: str | None, en: str | None, aliases: list[str] | None, plain: Plain = _BASE_PLAIN) -> list[str]:
    """All forms of a row. A given name alone is joined to the row's family name, never used by itself."""
    own: set[str] = set()
    for v in (ko, en):
        if v:
            own |= forms_of(v, plain=plain)
    families = {f.split("|")[1] for f in own if f[0] == "I"}
    for v in aliases or ():
        got = forms_of(v, alias=True, plain=plain)
        short = "".join(HANGUL.findall(v))
        if families and short and len(short) <= 2:
            got = set().union(*(_korean(fam, romanised(short)) for fam in families))
        own |= got
        families |= {f.split("|")[1] for f in got if f[0] == "I"}
    return sorted(own)


def grams(form: str) -> list[str]:
    """Padded trigrams of the parts, family name and initial as one term each. Forms that count as written only, and family names with an initial, have none."""
    kind, *parts = form.split("|")
    if kind in "AaI":
        return []
    three = lambda mark, p: {mark + q[i : i + 3] for q in (f"#{p}#",) for i in range(len(q) - 2)}
    if kind == "K":
        return sorted({f"KF{parts[0]}"} | three("K", parts[1]))
    if kind == "S":
        return sorted(three("S", parts[0]))
    return sorted(three("W", parts[0]) | {f"WI{parts[1][:1]}"} | (set() if parts[1].endswith(".") else three("w", parts[1])))


def compared(form: str) -> tuple[str, int]:
    """What ``confirmed`` asks to be equal (kind and Korean family), and the length it lets differ by one."""
    kind, *parts = form.split("|")
    return (f"K{parts[0]}", len(parts[1])) if kind == "K" else (kind, len(parts[0]))


@lru_cache(maxsize=200_000)
def _dimension(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % DIMENSIONS


def dimensions(form: str) -> list[int]:
    return sorted(set(map(_dimension, grams(form))))


class Space:
    """Weighted vectors of forms; the weight of a dimension is its rarity."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, tuple[dict[int, float], float]] = {}

    def vector(self, form: str) -> tuple[dict[int, float], float]:
        got = self.known.get(form)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            v = {d: float(self.weights[d]) for d in dimensions(form)}
            got = self.known[form] = (v, sum(w * w for w in v.values()) ** 0.5)
        return got

    def cosine(self, a: str, b: str) -> float:
        (x, nx), (y, ny) = self.vector(a), self.vector(b)
        if not nx or not ny:
            return 0.0
        if len(x) > len(y):
            x, y = y, x
        return sum(w * w for d, w in sorted(x.items()) if d in y) / (nx * ny)

    def prefix(self, form: str, cosine: float) -> list[int]:
        """Rarest dimensions first; the tail whose weight cannot reach the cosine alone is left out."""
        v, norm = self.vector(form)
        left, out = norm * norm, []
        for d in sorted(v, key=lambda d: (-v[d], d)):
            if left < cosine * cosine * norm * norm * (1 - 1e-9):
                break
            out.append(d)
            left -= v[d] * v[d]
        return out


def edits(a: str, b: str, most: int) -> int:
    """Edits with swapped neighbours as one; ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, two[j - 2] + 1)
            row.append(c)
        two, one = one, row
    return min(one[-1], most + 1)


def _close(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) >= 4 and edits(a, b, 1) == 1


def _given(a: str, b: str) -> bool:
    """Western given names: equal, misspelled, initial or short form."""
    if a == b:
        return True
    if a.endswith(".") or b.endswith("."):
        return a[0] == b[0]
    if b in _LONG_OF.get(a, ()) or a in _LONG_OF.get(b, ()) or _LONG_OF.get(a, set()) & _LONG_OF.get(b, set()) or _close(a, b):
        return True
    short, long = sorted((a, b), key=len)
    return len(short) <= 6 and len(long) > len(short) and (short[:2] == long[:2] or short[:3] in long or short[-3:] == long[-3:])


def confirmed(a: str, b: str) -> bool:
    """Whether the parts of two forms can be spellings of one another."""
    if a == b:
        return a[0] != "I"
    ka, *pa_ = a.split("|")
    kb, *pb = b.split("|")
    if ka != kb or ka in "AaI":
        return False
    if ka == "S":
        return _close(pa_[0], pb[0]) and (pa_[1] == pb[1] or not pa_[1] or not pb[1])
    if ka == "K":
        x, y = pa_[1], pb[1]
        return pa_[0] == pb[0] and (_close(x, y) or len(x) == len(y) == 3 and edits(x, y, 1) == 1)
    return _close(pa_[0], pb[0]) and _given(pa_[1], pb[1])


def clusters(n: int, links: dict[tuple[int, int], int], least: float = LINKAGE) -> list[int]:
    """Average linkage of ``n`` nodes over similarities in ``UNIT``; unlinked pairs count as 0. Returns the smallest node of each one's cluster.

    In rounds: all pairs of mutual best neighbours join; ties go to the smaller nodes.
    """
    size = [1] * n
    up = list(range(n))
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), t in links.items():
        near[i][j] = near[j][i] = t
    best: dict[int, tuple[float, int, int]] = {}
    changed = {i for i in range(n) if near[i]}
    while changed:
        for i in changed:
            best[i] = min(((-(t / (size[i] * size[j])), min(i, j), max(i, j)) for j, t in near[i].items()), default=(0.0, i, i))
        joins = [(i, j) for node in changed for a, i, j in (best[node],) if i < j and -a >= least * UNIT and best[i] == best[j]]
        touched: set[int] = set()
        for i, j in set(joins):
            for k, t in near[j].items():
                del near[k][j]
                if k != i:
                    near[i][k] = near[k][i] = near[i].get(k, 0) + t
            near[j] = {}
            best.pop(j)
            size[i] += size[j]
            up[j] = i
            touched.add(i)
        changed = touched | {k for i in touched for k in near[i]}
    for i in range(n):
        r = i
        while up[r] != r:
            r = up[r]
        up[i] = r
    return up


def entities_of(rows: list[tuple[str, str | None, list[str]]], links: list[tuple[str, str, int]], least: float = LINKAGE) -> list[tuple[str, str]]:
    """(ledger_id, entity) of one block: its rows (ledger_id, published id, forms) and links of forms (a, b, similarity)."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(x: str, y: str) -> None:
        x, y = sorted((top(x), top(y)))
        up[y] = x

    bearers: dict[str, list[str]] = defaultdict(list)
    named: set[str] = set()
    of_gy: dict[str, str] = {}
    for i, gy, forms in rows:
        up.setdefault(i, i)
        if gy is not None:
            join(i, of_gy.setdefault(gy, i))
        for f in forms:
            own = f if f[0] != "a" else "A" + f[1:]
            bearers[own].append(i)
            if f[0] != "a":
                named.add(own)
    for f, who in bearers.items():
        if f[0] != "I" and f in named:
            for i in who[1:]:
                join(who[0], i)
    ids = sorted({top(i) for i in up})
    at = {i: k for k, i in enumerate(ids)}
    nodes = {f: sorted({at[top(i)] for i in who}) for f, who in bearers.items()}
    between: dict[tuple[int, int], int] = {}
    for a, b, t in links:
        for i in nodes.get(a, ()):
            for j in nodes.get(b, ()):
                if i != j:
                    k = (min(i, j), max(i, j))
                    between[k] = max(t, between.get(k, 0))
    got = clusters(len(ids), between, least)
    label = {i: ids[got[at[top(i)]]] for i in up}
    # family name and initial: the one entity of the block they fit, or one another where none has more
    full: dict[str, set[str]] = defaultdict(set)
    only: dict[str, set[str]] = defaultdict(set)
    for i, _, forms in rows:
        for key, whole in filter(None, map(_family_initial, forms)):
            (full if whole else only)[key].add(label[i])
    moves: dict[str, str] = {}
    for key, who in only.items():
        to = min(who) if not full[key] else min(full[key]) if len(full[key]) == 1 else None
        for x in who if to is not None else ():
            if x != to:
                moves[x] = min(to, moves.get(x, to))
    members = defaultdict(list)
    for i in up:
        members[moves.get(label[i], label[i])].append(i)
    return [(i, min(m)) for m in members.values() if len(m) > 1 for i in m]


def _named_rows(artists: DataFrame, block: list[str]) -> DataFrame:
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in block])
    src = artists.filter(F.col("ledger_id").isNotNull()).select("ledger_id", value_of(F.col("gy_id")).alias("gy_id"), key.alias("block"), value_of(F.col("name_ko")).alias("ko"), value_of(F.col("name_en")).alias("en"), F.filter(F.transform(alias_values(F.col("aliases")), value_of), lambda v: v.isNotNull()).alias("aliases"))
    look = look_alikes(artists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Plain(look)
        for b in batches:
            forms = [row_forms(k, e, a, plain) for k, e, a in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(forms, pa.list_(pa.string()))], names=["ledger_id", "gy_id", "block", "forms"])

    return src.mapInArrow(run, "ledger_id string, gy_id string, block string, forms array<string>")


def _weights(forms: DataFrame) -> tuple[np.ndarray, int]:
    """Rarity of each dimension over all forms, and their number. At most ``DIMENSIONS`` sums come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for b in batches:
            for f in b.column(0).to_pylist():
                total[dimensions(f)] += 1
                total[DIMENSIONS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["d", "n"])

    seen = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in forms.select("form").mapInArrow(count, "d int, n bigint").groupBy("d").agg(F.sum("n").alias("n")).collect():
        seen[r[0]] = r[1]
    n = int(seen[DIMENSIONS])
    return np.log(1 + n / np.maximum(seen[:DIMENSIONS], 1)).astype(np.float32), n


def _links(forms: DataFrame, cosine: float) -> DataFrame:
    """(block, a, b, sim): confirmed pairs of forms of a block with their cosine, each once."""
    spark = forms.sparkSession
    weights, n = _weights(forms)
    held = spark.sparkContext.broadcast(weights)
    # blocks of more than 1/1000 of the forms: at most 1000
    large = {r[0]: r[1] for r in forms.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 1000 > n).collect()}

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefix of each form, and into how many chunks the postings of each dimension are expected to need cutting."""
        space = Space(held.value)
        for b in batches:
            out: list[tuple] = []
            for block, form in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pre = space.prefix(form, cosine)
                share = large.get(block, n / 1000) / max(n, 1)
                ks = [1 + int(n / np.expm1(space.weights[d]) * share // CELL) for d in pre]
                out.append((block, *compared(form), form, zlib.crc32(form.encode("utf-8", "surrogatepass")), pre, ks))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["block", "like", "size", "form", "mark", "pre", "ks"])

    vectors = Scratch(spark, "vectors").save(forms.select("block", "form").mapInArrow(prefixes, "block string, `like` string, size int, form string, mark bigint, pre array<int>, ks array<int>"), "pre")
    posts = vectors.select("block", "like", "size", "form", "mark", "pre", F.explode(F.arrays_zip(F.col("pre").alias("d"), F.col("ks").alias("k"))).alias("e")).select("block", "like", "size", "form", "pre", "e.d", "e.k", F.pmod("mark", "e.k").cast("int").alias("own"))
    # chunks of a dimension's postings meet pair by pair, each in a cell of its own
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c")
    posts = posts.select("*", other).withColumn("cell", F.least("own", "c") * F.col("k") + F.greatest("own", "c"))
    x, y = posts.alias("x"), posts.alias("y")
    # pairs that cannot be confirmed are not compared
    apt = (F.col("x.like") == F.col("y.like")) & (F.abs(F.col("x.size") - F.col("y.size")) <= 1)
    meet = (F.col("x.block") == F.col("y.block")) & apt & (F.col("x.d") == F.col("y.d")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.form") < F.col("y.form"))
    # chunks of one cell meet once, and a pair of forms at its first common dimension only
    once = ((F.col("x.own") != F.col("y.own")) | (F.col("x.cell") == F.col("x.own") * (F.col("x.k") + 1))) & (F.array_min(F.array_intersect("x.pre", "y.pre")) == F.col("x.d"))
    pairs = x.join(y, meet & once).select("x.block", F.col("x.form").alias("a"), F.col("y.form").alias("b"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(held.value)
        for p in batches:
            sims = [space.cosine(a, b) for a, b in zip(p.column(1).to_pylist(), p.column(2).to_pylist())]
            keep = [k for k, s in enumerate(sims) if s >= cosine]
            p = p.take(pa.array(keep, pa.int64()))
            sure = [confirmed(a, b) for a, b in zip(p.column(1).to_pylist(), p.column(2).to_pylist())]
            sim = pa.array([round(sims[k] * UNIT) for k in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([*p.columns, sim], names=["block", "a", "b", "sim"]).filter(pa.array(sure, pa.bool_()))

    return pairs.mapInArrow(judge, "block string, a string, b string, sim bigint")


def same_entities(artists: DataFrame, block: tuple[str, ...] = ("active_since", "region", "field"), cosine: float = COSINE, linkage: float = LINKAGE, task_rows: int = TASK_ROWS) -> DataFrame:
    """(ledger_id, gy_id, entity): rows clustered to entities; entity is the smallest id of the cluster.

    Only rows in an entity of two or more rows appear. Rows whose names are all
    null, blank or stand-ins are linked by their published id alone. Rows of one
    entity agree in the ``block`` columns (null agrees with null). Empty tables
    give nothing; other columns are ignored. ``task_rows`` decides where a block
    is clustered, not how.
    """
    spark = artists.sparkSession
    ship(spark)
    work = Scratch(spark, "names")
    rows = work.save(_named_rows(artists, list(block)), "rows")
    forms = work.save(rows.select("block", F.explode("forms").alias("form")).filter(~F.substring("form", 1, 1).isin("A", "a", "I")).groupBy("block", "form").agg(F.lit(1).alias("one")).drop("one"), "forms")
    links = work.save(_links(forms, cosine), "links")
    work.drop("forms")
    large = work.save(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_rows).select("block"), "large")
    some = bool(large.take(1))
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("block", F.lit(0).alias("part"), F.col("ledger_id").alias("a"), F.col("gy_id").alias("b"), none("bigint").alias("sim"), "forms").unionByName(links.select("block", F.lit(1).alias("part"), "a", "b", "sim", none("array<string>").alias("forms")))
    if some:
        both = both.join(large, "block", "left_anti")

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive whole and in order, and are clustered one after the other."""
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple[str, str | None, str]] = []
        for _, own in groupby(lines, key=lambda r: r[0]):
            mine, tied = [], []
            for _, part, a, b, sim, forms in own:
                if part:
                    tied.append((a, b, sim))
                else:
                    mine.append((a, b, forms))
            gy = {i: g for i, g, _ in mine}
            out += [(i, gy[i], e) for i, e in entities_of(mine, tied, linkage)]
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    got = both.repartition("block").sortWithinPartitions("block", "part").mapInArrow(cluster, "ledger_id string, gy_id string, entity string")
    if some:
        got = got.unionByName(_large_entities(rows.join(large, "block", "left_semi"), links.join(large, "block", "left_semi"), linkage, work))
    got = work.save(got, "entities")
    work.keep_only("entities")
    return got


def _batch(rows: list[tuple[str, str | None, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1, 2)], names=["ledger_id", "gy_id", "entity"])


def _large_entities(rows: DataFrame, links: DataFrame, linkage: float, work: Scratch) -> DataFrame:
    """As ``entities_of``, for blocks larger than a task, in Spark."""
    has = rows.select("block", "ledger_id", F.explode("forms").alias("f")).select("block", "ledger_id", F.regexp_replace("f", r"^a\|", "A|").alias("form"), (~F.col("f").startswith("a|")).alias("named"))
    has = work.save(has, "has")
    hub = has.filter(~F.col("form").startswith("I|")).groupBy("block", "form").agg(F.bool_or("named").alias("named"), F.count(F.lit(1)).alias("n")).filter("named AND n > 1").select(F.concat_ws("\u0001", "block", "form").alias("k"))
    tie = has.select("ledger_id", F.concat_ws("\u0001", "block", "form").alias("k"))
    by_form = skew_left_join(tie, hub.withColumn("u", F.lit(True)), "k", hot_keys(tie, "k"), "inner").select(F.col("ledger_id").alias("a"), F.concat(F.lit("f\u0001"), "k").alias("b"))
    by_gy = rows.filter("gy_id IS NOT NULL").select(F.col("ledger_id").alias("a"), F.concat_ws("\u0001", F.lit("g"), "block", "gy_id").alias("b"))
    comp = work.save(match_groups(work.save(by_form.unionByName(by_gy), "ties"), "a", "b", "x", "comp"), "comp")
    mine = comp.filter(~F.col("x").contains("\u0001"))
    least = mine.groupBy("comp").agg(F.min("x").alias("node"))
    united = skew_left_join(mine, least, "comp", hot_keys(mine, "comp"), "inner").select(F.col("x").alias("ledger_id"), "node")
    node = work.save(rows.select("block", "ledger_id").join(united, "ledger_id", "left").select("block", "ledger_id", F.coalesce("node", "ledger_id").alias("node")), "node")
    bears = work.save(has.join(node, ["block", "ledger_id"]).select("block", "form", "node").distinct(), "bears")
    x, y = bears.select("block", F.col("form").alias("a"), F.col("node").alias("i")), bears.select("block", F.col("form").alias("b"), F.col("node").alias("j"))
    edges = links.join(x, ["block", "a"]).join(y, ["block", "b"]).filter("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("sim").alias("t"))
    edges = work.save(edges.withColumn("ni", F.lit(1)).withColumn("nj", F.lit(1)), "edges0")
    label = work.save(node.select("node").distinct().withColumn("root", F.col("node")), "label0")
    k = 0
    while True:
        ranked = edges.withColumn("s", -(F.col("t") / (F.col("ni") * F.col("nj"))))
        best = ranked.select(F.explode(F.array("i", "j")).alias("v"), F.struct("s", "i", "j", "ni", "nj").alias("r")).groupBy("v").agg(F.min("r").alias("r"))
        joins = best.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == 2) & (-F.col("r.s") >= linkage * UNIT))
        joins = work.save(joins.select(F.col("r.j").alias("gone"), F.col("r.i").alias("into"), (F.col("r.ni") + F.col("r.nj")).alias("size")), f"joins{k}")
        if not joins.take(1):
            break
        moves = joins.select(F.col("gone").alias("v"), "into", "size").unionByName(joins.select(F.col("into").alias("v"), "into", "size"))
        for end, size in (("i", "ni"), ("j", "nj")):
            to = moves.select(F.col("v").alias(end), "into", "size")
            edges = skew_left_join(edges, to, end, hot_keys(edges, end)).withColumn(end, F.coalesce("into", end)).withColumn(size, F.coalesce("size", size)).drop("into", "size")
        turned = F.col("i") > F.col("j")
        edges = edges.filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "t", F.when(turned, F.col("nj")).otherwise(F.col("ni")).alias("ni"), F.when(turned, F.col("ni")).otherwise(F.col("nj")).alias("nj"))
        k += 1
        edges = work.save(edges.groupBy("i", "j").agg(F.sum("t").alias("t"), F.max("ni").alias("ni"), F.max("nj").alias("nj")), f"edges{k}")
        to = joins.select(F.col("gone").alias("root"), "into")
        label = work.save(skew_left_join(label, to, "root", hot_keys(label, "root")).select("node", F.coalesce("into", "root").alias("root")), f"label{k}")
    named = skew_left_join(node, label, "node", hot_keys(node, "node")).select("block", "ledger_id", F.coalesce("root", "node").alias("label"))
    final = _with_initials(rows, work.save(named, "named"))
    final = work.save(final, "final")
    least = final.groupBy("label").agg(F.min("ledger_id").alias("entity"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", "entity")
    return skew_left_join(final, least, "label", hot_keys(final, "label"), "inner").select("ledger_id", "gy_id", "entity")


def _with_initials(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(ledger_id, gy_id, label): rows that give a family name and initials only join the one entity of the block they fit.

    If several entities of the block have that family name and initial, nothing
    tells which is meant and the row stays alone; if none has, rows of equal
    initials are one. Counted by map-side combined aggregates, so a family name
    shared by many rows costs nothing.
    """
    own = rows.join(labels, ["block", "ledger_id"])
    i = own.select("block", "label", F.explode(F.filter("forms", lambda f: f.startswith("I|"))).alias("f"))
    i = i.select("block", "label", F.regexp_replace("f", r"\|[a-z]+$", "").alias("key"), F.col("f").endswith("|only").alias("only"))
    full = i.filter(~F.col("only")).groupBy("block", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    only = i.filter("only").groupBy("block", "key", "label").agg(F.lit(1).alias("one")).drop("one")
    alone = only.groupBy("block", "key").agg(F.min("label").alias("least"))
    fits = only.join(full, ["block", "key"], "left").join(alone, ["block", "key"])
    target = F.when(F.col("lo").isNull(), F.col("least")).when(F.col("lo") == F.col("hi"), F.col("lo"))
    moves = fits.withColumn("to", target).filter("to IS NOT NULL AND to <> label").groupBy("label").agg(F.min("to").alias("to"))
    return skew_left_join(own.select("ledger_id", "gy_id", "label"), moves, "label", hot_keys(own, "label")).select("ledger_id", "gy_id", F.coalesce("to", "label").alias("label"))


def variant_pairs(artists: DataFrame) -> DataFrame:
    """(ledger_id_a, ledger_id_b), a < b: rows of one entity that do not share a published id."""
    ents = same_entities(artists)
    x, y = ents.alias("x"), ents.alias("y")
    apart = ~F.coalesce(F.col("x.gy_id") == F.col("y.gy_id"), F.lit(False))
    return x.join(y, (F.col("x.entity") == F.col("y.entity")) & (F.col("x.ledger_id") < F.col("y.ledger_id")) & apart).select(F.col("x.ledger_id").alias("ledger_id_a"), F.col("y.ledger_id").alias("ledger_id_b"))
