"""Pairs of entities present together, as bits: for groups whose pairs are far more than their members.

Entities are numbered in their order and cut into blocks; a cell is a pair of
blocks. A task gets the groups of both blocks and sets a bit for each pair, so a
pair that many groups give exists once and no pair is shuffled: what is shuffled
are the members, packed, once per block.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import Scratch
from .joins import hot_keys, skew_left_join

#: Entities of a block: a cell has at most this many squared bits (2 MB).
ENTITIES = 4096
#: Blocks there are at least, for enough cells to work on side by side.
LEAST_BLOCKS = 8
#: Members packed into one part; a block of more has several, which are added up in the cell.
PART_ROWS = 1_000_000
#: Groups whose members are held as bits at a time (16 MB).
GROUPS = 32_768
#: Rows of a cell that are spelt out at a time.
ROWS = 256
#: Up to here whole numbers are exact in single precision.
EXACT = 1 << 24
#: The part of a block that says what its entities are; it comes first.
HEAD = -1

#: What a head says: names, places of the named in their block, packed counts.
Head = tuple[pa.Array | None, pa.Array | None, bytes | None]


def blocks_for(entities: int, size: int = ENTITIES) -> int:
    return max(LEAST_BLOCKS, -(-entities // size))


class Members:
    """Written (grp, entity) rows in numbered form: entities by block and place in it, groups by code."""

    def __init__(self, members: DataFrame, total: int, size: int = ENTITIES, part_rows: int = PART_ROWS):
        self.spark = members.sparkSession
        ship(self.spark)
        self.work = work = Scratch(self.spark, "dense")
        groups = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        groups = work.save(groups.select("grp", F.monotonically_increasing_id().alias("code")), "groups")
        # the number is taken where the order is made: its upper bits are the partition, its lower 33 the row
        order = members.select("entity").distinct().orderBy("entity").withColumn("at", F.monotonically_increasing_id())
        part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        order = work.save(order.select("entity", part.cast("int").alias("part"), row.alias("row")), "order")
        counts = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        starts = dict(zip(sorted(counts), itertools.accumulate([0, *(counts[k] for k in sorted(counts))])))
        n = sum(counts.values())
        self.blocks = blocks_for(n, size)
        self.each = each = max(1, -(-n // self.blocks))
        first = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]) if starts else F.lit(None)
        number = (F.element_at(first, F.col("part")) if starts else F.lit(0)) + F.col("row")
        self.entities = order.select("entity", F.floor(number / each).cast("int").alias("block"), (number % each).cast("int").alias("idx"))
        coded = skew_left_join(members, groups, "grp", hot_keys(members, "grp", total=total), "inner").select("entity", "code")
        coded = skew_left_join(coded, self.entities, "entity", hot_keys(members, "entity", total=total), "inner")
        self.coded = work.save(coded.select("block", "idx", "code"), "coded")
        most = self.coded.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        self.parts = max(1, -(-most // part_rows))

    def cells(self, heads: DataFrame) -> DataFrame:
        """(lo, hi, part, side, names, idx, counts, data): the parts of both blocks of each cell, in order, cells kept together.

        ``heads``: (block, names, idx, counts) of the entities of each block.
        """
        cut = self.coded.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(self.parts)).cast("int"))
        packed = cut.groupBy("block", "part").applyInArrow(_packed, "block int, part int, data binary")
        kind = heads.select("names", "idx", "counts").schema
        none = [F.lit(None).cast(k.dataType).alias(k.name) for k in kind]
        every = heads.select("block", F.lit(HEAD).alias("part"), "names", "idx", "counts", F.lit(None).cast("binary").alias("data"))
        every = every.unionByName(packed.select("block", "part", *none, "data"))
        # written, so that packing is done once
        every = self.work.save(every, "parts").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        out = every.select(F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "part", (F.col("block") > F.col("o")).cast("int").alias("side"), *kind.names, "data")
        n = min(2000, self.blocks * (self.blocks + 1) // 2)
        return out.repartition(n, "lo", "hi").sortWithinPartitions("lo", "hi", "part", "side")

    def _on(self, made: Callable[[int, int, Head, Head, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
        each = self.each
        return lambda batches: itertools.chain.from_iterable(made(*cell) for cell in _cells(batches, each))

    def plain_heads(self) -> DataFrame:
        """Each block's entities in order."""
        own = self.entities.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "entity"))).alias("x"))
        return own.select("block", F.col("x.entity").alias("names"), F.col("x.idx").alias("idx"), F.lit(None).cast("binary").alias("counts"))

    def pairs(self) -> DataFrame:
        """(src, dst), src < dst: each pair once."""
        kind = self.entities.schema["entity"].dataType.simpleString()
        got = self.cells(self.plain_heads()).mapInArrow(self._on(_listed), f"src {kind}, dsts array<{kind}>")
        return got.select("src", F.explode("dsts").alias("dst"))

    def degrees(self) -> DataFrame:
        """(entity, degree): partners of each entity with one; no pair is listed."""
        kind = self.entities.schema["entity"].dataType.simpleString()
        got = self.cells(self.plain_heads()).mapInArrow(self._on(_degrees), f"entity {kind}, n bigint")
        return got.groupBy("entity").agg(F.sum("n").alias("degree"))

    def tied(self, labelled: DataFrame, counts: Column | None = None) -> DataFrame:
        """(draw, t, s): over all pairs, the sum of products of both ends' counts, and of those with one label; draws from 1.

        ``labelled``: (entity, label, counts), where counts has one number per draw;
        an entity may have several rows. No pair is listed. Long arrays are better
        given as ``counts``, made of the entity: only those with groups get them then.
        """
        own = labelled.select("entity", F.col("label").cast("string").alias("label"), *(["counts"] if counts is None else []))
        # merged: Spark takes an array for a single number, so it would broadcast many
        own = own.join(self.entities.hint("merge"), "entity").withColumn("counts", F.col("counts") if counts is None else counts)
        heads = own.groupBy("block").applyInArrow(_head, "block int, names array<string>, idx array<int>, counts binary")
        got = self.cells(heads).mapInArrow(self._on(_sums), "draw int, t double, s double")
        return got.groupBy("draw").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))


def _packed(part: pa.Table) -> pa.Table:
    """A part of a block as one row: its group codes, and per member the place of the entity and of the code; by entity."""
    codes, at = np.unique(part["code"].to_numpy(), return_inverse=True)
    idx = part["idx"].to_numpy()
    order = np.lexsort((at, idx))
    file = io.BytesIO()
    np.savez_compressed(file, codes=codes, at=at[order].astype(np.int32), idx=idx[order].astype(np.int32))
    return pa.table({"block": pa.array([part["block"][0].as_py()], pa.int32()), "part": pa.array([part["part"][0].as_py()], pa.int32()), "data": pa.array([file.getvalue()], pa.binary())})


def _head(own: pa.Table) -> pa.Table:
    """The labelled rows of a block as one row; counts are packed, since a head goes to as many cells as there are blocks."""
    file = io.BytesIO()
    np.savez_compressed(file, counts=pc.list_flatten(own["counts"]).to_numpy())
    lists = [pa.array([own[c].to_pylist()], pa.list_(kind)) for c, kind in (("label", pa.string()), ("idx", pa.int32()))]
    return pa.table({"block": pa.array([own["block"][0].as_py()], pa.int32()), "names": lists[0], "idx": lists[1], "counts": pa.array([file.getvalue()], pa.binary())})


def _cells(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, Head, Head, np.ndarray]]:
    """(lo, hi, both heads, bits) of each cell: a row of bits per entity of the lower block; within a block for src < dst only."""
    words = -(-n // 64)
    keys = ("lo", "hi", "part", "side")
    rows = (((*k,), b, r) for b in batches for r, k in enumerate(zip(*(b.column(c).to_pylist() for c in keys))))
    for (lo, hi), own in itertools.groupby(rows, key=lambda x: x[0][:2]):
        bits, heads = np.zeros((n, words), np.uint64), {}
        for part, sides in itertools.groupby(own, key=lambda x: x[0][2]):
            got = {k[3]: (b, r) for k, b, r in sides}
            if lo == hi:
                got[1] = got[0]
            if part == HEAD:
                heads = {side: (b.column("names")[r].values, b.column("idx")[r].values, b.column("counts")[r].as_py()) for side, (b, r) in got.items()}
            elif len(got) == 2:
                _set(bits, *(np.load(io.BytesIO(b.column("data")[r].as_py())) for b, r in (got[0], got[1])))
        if lo == hi:
            bits &= np.packbits(np.triu(np.ones((n, words * 64), bool), 1), axis=1, bitorder="little").view(np.uint64)
        if len(heads) == 2:
            yield lo, hi, heads[0], heads[1], bits


def _set(bits: np.ndarray, lo: np.lib.npyio.NpzFile, hi: np.lib.npyio.NpzFile) -> None:
    """Set the bits of all pairs that share a group of these parts."""
    codes = [x["codes"] for x in (lo, hi)]
    both, *found = np.intersect1d(*codes, assume_unique=True, return_indices=True)
    grp, idx = [], []
    for x, own, at in zip((lo, hi), codes, found):
        place = np.full(len(own), -1, np.int32)
        place[at] = np.arange(len(both), dtype=np.int32)
        g = place[x["at"]]
        grp.append(g[g >= 0])
        idx.append(x["idx"][g >= 0])
    for first in range(0, len(both), GROUPS):
        u, v = ((g >= first) & (g < first + GROUPS) for g in grp)
        mask = np.zeros((min(GROUPS, len(both) - first), bits.shape[1] * 8), np.uint8)
        np.bitwise_or.at(mask, (grp[1][v] - first, idx[1][v] >> 3), (1 << (idx[1][v] & 7)).astype(np.uint8))
        mask, g, a = mask.view(np.uint64), grp[0][u] - first, idx[0][u]
        ends = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for x, y in itertools.pairwise(ends):
            if y > x:
                bits[a[x]] |= np.bitwise_or.reduce(mask[g[x:y]], axis=0)


def _on_of(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")


def _listed(lo: int, hi: int, one: Head, two: Head, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(bits), ROWS):
        some = bits[first : first + ROWS]
        n = np.bitwise_count(some).sum(axis=1)
        rows = np.flatnonzero(n)
        if len(rows):
            at = np.flatnonzero(_on_of(some)) % (bits.shape[1] * 64)
            ends = np.concatenate(([0], np.cumsum(n[rows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([one[0].take(pa.array(rows + first)), pa.ListArray.from_arrays(pa.array(ends), two[0].take(pa.array(at)))], ["src", "dsts"])


def _degrees(lo: int, hi: int, one: Head, two: Head, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    into = sum(_on_of(bits[k : k + ROWS]).sum(axis=0, dtype=np.int64) for k in range(0, len(bits), ROWS))
    for (names, _, _), n in ((one, out), (two, into)):
        rows = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(n[rows])], ["entity", "n"])


def _sums(lo: int, hi: int, one: Head, two: Head, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    code: dict[str, int] = {}
    sides = []
    for by, (labels, idx, counts) in enumerate((one, two)):
        label = np.array([code.setdefault(x, len(code)) for x in labels.to_pylist()])
        idx = idx.to_numpy()
        order = np.argsort(idx if by == 0 else label, kind="stable")  # rows of a chunk, or of a label, stand together
        sides.append((label[order], idx[order], np.load(io.BytesIO(counts))["counts"].reshape(len(idx), -1)[order].astype(np.float64)))
    (la, ia, ca), (lb, ib, cb) = sides
    narrow = cb.sum(axis=0).max(initial=0) < EXACT
    cb = cb.astype(np.float32) if narrow else cb
    t, s = np.zeros(cb.shape[1]), np.zeros(cb.shape[1])
    for first in range(0, len(bits), ROWS):
        own = slice(*np.searchsorted(ia, (first, first + ROWS)))
        if own.start == own.stop:
            continue
        on = _on_of(bits[first : first + ROWS])[ia[own] - first][:, ib].astype(cb.dtype)
        t += (ca[own] * (on @ cb)).sum(axis=0)
        for k in np.unique(la[own]):
            rows, cols = la[own] == k, slice(*np.searchsorted(lb, (k, k + 1)))
            s += (ca[own][rows] * (on[rows, cols] @ cb[cols])).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(t) + 1, dtype=np.int32)), pa.array(t), pa.array(s)], ["draw", "t", "s"])
