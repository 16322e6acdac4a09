"""Texts as hashed count vectors, so a query and its documents meet in one space."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 32-bit FNV-1a hash.
OFFSET, PRIME = 0x811C9DC5, 0x01000193


def fnv1a(s: str) -> int:
    h = OFFSET
    for b in s.encode("utf-8"):
        h = (h ^ b) * PRIME & 0xFFFFFFFF
    return h


def hashed(text: str | None, dim: int = 64) -> list[float]:
    """Counts of the words, and of letter pairs inside Hangul words, by hash; unit length, zeros for no words."""
    v = [0.0] * dim
    for w in re.findall(r"[a-z0-9]{2,}|[가-힣]{2,}", (text or "").lower()):
        for token in {w, *(w[i : i + 2] for i in range(len(w) - 1) if "가" <= w[0] <= "힣")}:
            v[fnv1a(token) % dim] += 1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def text_vector(c: Column, dim: int = 64) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: hashed(t if isinstance(t, str) else None, dim))

    return run(c)
