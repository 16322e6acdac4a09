"""A pluggable language: what depends on how names are written, behind one small protocol."""

from __future__ import annotations

import importlib
import re
import unicodedata
from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CODAS, NUCLEI, ONSETS

#: Korean family names and the ways they are written in Latin letters.
FAMILIES = {
    "김": "kim gim", "이": "lee rhee yi i", "박": "park bak pak", "최": "choi choe", "정": "jung jeong chung", "조": "cho jo", "윤": "yoon yun", "장": "jang chang", "임": "lim im rim yim",
    "한": "han hahn", "오": "oh o", "서": "seo suh", "신": "shin sin", "권": "kwon gwon", "황": "hwang whang", "안": "ahn an", "송": "song", "유": "yu yoo you ryu lyu", "홍": "hong houng",
    "전": "jeon chun", "고": "ko go koh", "문": "moon mun", "양": "yang", "손": "son sohn", "배": "bae pae", "백": "baek paik", "허": "heo hur huh", "남": "nam nahm", "심": "shim sim",
    "노": "noh no roh", "하": "ha", "곽": "kwak gwak", "성": "sung seong", "차": "cha", "주": "joo ju", "우": "woo u", "구": "koo ku gu", "민": "min", "나": "na ra", "지": "ji chi", "강": "kang gang",
    "진": "jin chin", "엄": "um eom", "채": "chae", "원": "won", "천": "cheon", "방": "bang", "공": "gong kong", "현": "hyun hyeon", "변": "byun byeon", "여": "yeo", "석": "seok", "추": "choo chu",
}
#: Family names with two sounds, under the one listed above.
SAME_FAMILY = {"류": "유", "리": "이", "림": "임", "로": "노", "라": "나"}


@runtime_checkable
class Language(Protocol):
    def personal(self, name: str) -> bool: ...

    def name_keys(self, name: str) -> list[str]: ...

    def romanise(self, text: str) -> str: ...


def nfc_fold(s: str) -> str:
    """Composed form of the Latin letters without their marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe")


class KoreanEnglish:
    """Hangul and Latin names: shapes, romanised keys in both orders, common spellings."""

    def __init__(self) -> None:
        self.first = {ko: ws.split()[0] for ko, ws in FAMILIES.items()}
        self.root = {w: self.first[ko] for ko, ws in FAMILIES.items() for w in ws.split()}

    def syllable(self, ch: str) -> str:
        k = ord(ch) - 44032
        return ONSETS[k // 588] + NUCLEI[k % 588 // 28] + CODAS[k % 28] if 0 <= k < 11172 else ch

    def romanise(self, text: str) -> str:
        return "".join(map(self.syllable, text))

    def personal(self, name: str) -> bool:
        compact = re.sub(r"\s+", "", name)
        if re.fullmatch("[가-힣]{2,4}", compact):
            return True
        return bool(re.fullmatch(r"[A-Za-zÀ-ɏ.'’-]+(?:\s+[A-Za-zÀ-ɏ.'’-]+){1,5}", name.strip()))

    def name_keys(self, name: str) -> list[str]:
        """``family/given`` keys; a Latin name gives both orders, a common family name all its spellings' root."""
        root = self.root
        hangul = "".join(re.findall("[가-힣]", name))
        if hangul:
            if not 2 <= len(hangul) <= 4:
                return []
            fam = SAME_FAMILY.get(hangul[0], hangul[0])
            return [f"{self.first.get(fam, self.romanise(fam))}/{self.romanise(hangul[1:])}"]
        parts = re.findall(r"[a-z]+", nfc_fold(name).replace("-", ""))
        if len(parts) < 2:
            return []
        both = ((parts[0], parts[1:]), (parts[-1], parts[:-1]))
        return sorted({f"{root.get(f, f)}/{''.join(g)}" for f, g in both})


def load(path: str) -> Language:
    """``package.module:Class`` as an instance that speaks the protocol."""
    module, _, name = path.partition(":")
    lang = getattr(importlib.import_module(module), name)()
    if not isinstance(lang, Language):
        raise TypeError(f"{path} is no language")
    return lang


def name_keys(c: Column, path: str = "kinweave.functions.language:KoreanEnglish") -> Column:
    """Keys of a name column, by the language at ``path``; null and empty names have none."""

    @F.pandas_udf("array<string>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lang = load(path)
        memory: dict[str, list[str]] = {}
        for names in batches:
            out = []
            for n in names:
                if not n:
                    out.append([])
                    continue
                if n not in memory:
                    if len(memory) > 100_000:
                        memory.clear()
                    memory[n] = lang.name_keys(n)
                out.append(memory[n])
            yield pd.Series(out)

    return keys(c)
