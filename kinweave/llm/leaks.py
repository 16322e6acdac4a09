"""Evaluation texts leaking into training text.

Wu-Manber search with words as the alphabet. The patterns are all runs of m
successive words of the items. A block of the last B words under the search
position looks up how far the position may jump; where it may not, the hash
bucket of the block names the patterns that end so, and a direct comparison
confirms. Most positions of a document are never looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Successive words that make a leak.
LEAK_WORDS = 12
#: Words of a block.
BLOCK = 3
#: Words of the items one search holds in every task; longer items are searched in several parts, each over all documents.
PART_WORDS = 1_000_000
SIGNS = re.compile(r"[^\w\s]+|_+")


def words_of(text: str) -> list[str]:
    """Words without punctuation and without regard to case (as in STRASSE for Straße); composed form, so that accents compare."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFC", text.casefold())
    return SIGNS.sub("", t).split()


class Patterns:
    """Shift table over blocks, and the buckets of patterns by their last block.

    A pattern is kept as the place where it starts in the words of all items laid
    end to end, so its words are stored once however many patterns hold them.
    """

    def __init__(self, items: list[tuple[object, str]], m: int = LEAK_WORDS, b: int = BLOCK):
        self.m, self.b = m, min(b, m)
        self.words: list[str] = []
        self.starts: list[int] = []
        self.items: list[object] = []
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = {}
        same: dict[str, str] = {}
        for item, text in items:
            own = [same.setdefault(w, w) for w in words_of(text or "")]
            if len(own) < m:
                continue
            at = len(self.words)
            self.starts.append(at)
            self.items.append(item)
            self.words += own
            for start in range(len(own) - m + 1):
                for end in range(self.b, m + 1):
                    block = hash(tuple(own[start + end - self.b : start + end]))
                    self.shift[block] = min(self.shift.get(block, m), m - end)
                self.bucket.setdefault(hash(tuple(own[start + m - self.b : start + m])), []).append(at + start)

    def search(self, text: str) -> set[object]:
        """Items of which the text holds a pattern."""
        w = words_of(text)
        m, b, found = self.m, self.b, set()
        shift, far = self.shift.get, self.m - self.b + 1
        end, n = m, len(w)
        while end <= n:
            block = hash(tuple(w[end - b : end]))
            jump = shift(block, far)
            if jump:
                end += jump
                continue
            here = w[end - m : end]
            for at in self.bucket[block]:
                if self.words[at : at + m] == here:
                    found.add(self.items[bisect_right(self.starts, at) - 1])
            end += 1
        return found


_held: dict[str, Patterns] = {}


def _patterns(key: str, items: list[tuple[object, str]], m: int) -> Patterns:
    """The patterns of one run, kept by the worker between its tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = Patterns(items, m)
    return _held[key]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, m: int = LEAK_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``m`` successive words of the item.

    Null and empty texts hold nothing, and items shorter than ``m`` words cannot
    leak. Repeated documents are each reported. The items are the one side held
    in every task: those of more than ``part_words`` words are cut by their id into
    parts of about that size, and the documents are searched once for each part.
    Documents are read whole and not shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, math.ceil(size / part_words))
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_searched(docs, doc_id, text, items.filter(part == k), m) for k in range(parts)])


def _searched(docs: DataFrame, doc_id: str, text: str, items: DataFrame, m: int) -> DataFrame:
    shared, run_key = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    kinds = src.schema["doc_id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    item_type = pa.int64() if kinds[1] == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(run_key, shared.value, m)
        for batch in batches:
            ids, got = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item in sorted(patterns.search(t)):
                    ids.append(i), got.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(got, item_type)], names=["doc_id", "item_id"])

    return src.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}")
