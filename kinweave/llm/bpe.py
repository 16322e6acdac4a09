"""Encoding a corpus with a public byte-level BPE vocabulary.

Per Arrow batch the words not seen before are laid end to end as one array of
symbols. A pair occurrence index maps every pair to all its positions; the
ranks present are applied in ascending order, and a merge updates the lists of
its two neighbour pairs only. A pair made by a merge always has a higher rank
than the merge itself, so one ascending pass is exact.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..shipping import ship

#: Folder of the public vocabulary files; a parameter of every entry point.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's own word pattern splits text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept between batches of one worker; a full memory is emptied, which costs time only.
WORD_MEMORY = 150_000


class Bpe:
    """Ranks of one vocabulary, given as the bytes of its file, and the words encoded so far."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        self.pattern = regex.compile(WORDS)
        self.known: dict[str, list[int]] = {}

    def merge_of(self, a: int, b: int) -> int:
        """Rank of the pair, or -1."""
        key = (a, b)
        r = self.merged.get(key)
        if r is None:
            r = self.merged[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by one pair occurrence index over all of them."""
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            at = len(sym)
            starts.append(at)
            n = len(data)
            sym.extend(map(self.single.__getitem__, data))
            prv.extend(range(at - 1, at + n - 1))
            nxt.extend(range(at + 1, at + n + 1))
            if n:
                prv[at] = -1
                nxt[-1] = -1
        where: dict[tuple[int, int], list[int]] = {}
        ranked: dict[int, list[tuple[int, int]]] = {}
        heap: list[int] = []
        merge_of = self.merge_of

        def note(a: int, b: int, i: int) -> None:
            at = where.get((a, b))
            if at is not None:
                at.append(i)
                return
            r = merge_of(a, b)
            if r < 0:
                return
            where[(a, b)] = [i]
            pairs = ranked.get(r)
            if pairs is None:
                ranked[r] = [(a, b)]
                heapq.heappush(heap, r)
            else:
                pairs.append((a, b))

        for i, j in enumerate(nxt):
            if j >= 0:
                note(sym[i], sym[j], i)
        while heap:
            r = heapq.heappop(heap)
            for pair in ranked.pop(r):
                a, b = pair
                spots = where.pop(pair)
                spots.sort()
                for i in spots:
                    if sym[i] != a:
                        continue
                    j = nxt[i]
                    if j < 0 or sym[j] != b:
                        continue
                    k = nxt[j]
                    sym[i] = r
                    sym[j] = -1
                    nxt[i] = k
                    if k >= 0:
                        prv[k] = i
                        note(r, sym[k], i)
                    h = prv[i]
                    if h >= 0:
                        note(sym[h], r, h)
        out = []
        for at, w in zip(starts, words):
            ids = []
            i = at if w else -1
            while i >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for a null or empty one."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > WORD_MEMORY:
            known.clear()
        new = list({w for ws in split for w in ws if w not in known})
        known.update(zip(new, self.encode_words(new)))
        return [[i for w in ws for i in known[w]] for ws in split]


def load(path: str) -> Bpe:
    return Bpe(Path(path).read_bytes())


_held: dict[str, Bpe] = {}


def _bpe(key: str, vocabulary: bytes) -> Bpe:
    """The vocabulary of one file, kept by the worker between its tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = Bpe(vocabulary)
    return _held[key]


def encoded(docs: DataFrame, doc_id: str, text: str, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids array<int>): one row per row of ``docs``, without special tokens.

    A null or empty text gives an empty list; special-token strings inside a text
    are ordinary text; texts are encoded whole. No shuffle. The vocabulary is read
    where the query is built and sent to the executors (a file of about 1 MB).
    """
    vocabulary = Path(path).read_bytes()
    key, shared = hashlib.sha256(vocabulary).hexdigest(), docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(key, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = bpe.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    ship(docs.sparkSession)
    src = docs.select(doc_id, text)
    return src.mapInArrow(run, f"doc_id {src.schema[doc_id].dataType.simpleString()}, ids array<int>")
