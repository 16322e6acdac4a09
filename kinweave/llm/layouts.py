"""Duplicates hidden by formatting differences.

Canonical records are written once, range-partitioned by (128-bit hash of the
key, id) and sorted externally with the full key; each sorted partition is then scanned once,
comparing the full keys of neighbours. The range cuts fall inside a large group
too, so no group has to fit one task; what crosses a cut is stitched from one
descriptor per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import Scratch

#: Units a year may carry.
YEAR_UNITS = "년|年"
SIGNS = r"[^\p{L}\p{N}\p{M}]+"
BETWEEN = "\u0001"


def folded(c: Column) -> Column:
    """Lower case, with the letters that have two lower-case forms brought to one."""
    return F.replace(F.translate(F.lower(c), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def plain_text_key(c: Column) -> Column:
    """Letters and digits in order, lower case; a cell of signs only is compared by its signs."""
    bare = F.regexp_replace(folded(c), SIGNS, "")
    return F.when(bare != "", bare).otherwise(F.regexp_replace(c, r"[\s\p{Z}]+", ""))


def any_order_key(c: Column) -> Column:
    """As ``plain_text_key``, with the words in sorted order: parts of a cell may stand in any order."""
    words = F.array_sort(F.filter(F.split(folded(c), SIGNS, -1), lambda w: w != ""))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.regexp_replace(c, r"[\s\p{Z}]+", ""))


def year_key(c: Column) -> Column:
    """Digits and letters of a year cell without its unit."""
    return F.regexp_replace(plain_text_key(c), rf"(?<=\d)(?:{YEAR_UNITS})$", "")


def filled(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\s\p{Z}]+", "") != "", F.lit(False))


_SCAN = pa.schema([("pid", pa.int32()), ("first_id", pa.string()), ("copy_id", pa.string()), ("in_first", pa.bool_()), ("first_key", pa.string()), ("last_key", pa.string()), ("head_id", pa.string()), ("single", pa.bool_())])
_SCAN_SQL = "pid int, first_id string, copy_id string, in_first boolean, first_key string, last_key string, head_id string, single boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of each run, then one descriptor of the partition (copy_id null)."""
    pid = TaskContext.get().partitionId()
    first_key = last_key = head = run_first = None
    runs = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, ids = batch.column("key"), batch.column("id")
        same = pc.equal(key.slice(1), key.slice(0, n - 1)).to_pylist() if n > 1 else []
        if first_key is None:
            first_key, head = key[0].as_py(), ids[0].as_py()
            starts = [True, *(not x for x in same)]
        else:
            starts = [key[0].as_py() != last_key, *(not x for x in same)]
        last_key = key[n - 1].as_py()
        firsts, copies, in_first = [], [], []
        at = 0
        while at < n:
            if starts[at]:
                runs += 1
                run_first = ids[at].as_py()
            else:
                firsts.append(run_first)
                copies.append(ids[at].as_py())
                in_first.append(runs == 1)
            at += 1
        m = len(firsts)
        if m:
            nulls = pa.nulls(m, pa.string())
            yield pa.record_batch([pa.array([pid] * m, pa.int32()), pa.array(firsts, pa.string()), pa.array(copies, pa.string()), pa.array(in_first), nulls, nulls, nulls, pa.nulls(m, pa.bool_())], schema=_SCAN)
    if first_key is not None:
        yield pa.record_batch([pa.array([x], t.type) for x, t in zip([pid, run_first, None, None, first_key, last_key, head, runs == 1], _SCAN)], schema=_SCAN)


def copies_of_records(df: DataFrame, row_id: str, key: Column) -> DataFrame:
    """(first_id, copy_id): for each group of rows with equal ``key``, every row but the one of the smallest id.

    Rows with a null key or id are left out. Repeated ids give repeated rows. An
    empty table gives none; other columns are ignored.
    """
    ship(df.sparkSession)
    work = Scratch(df.sparkSession, "copies")
    rows = df.select(key.alias("key"), F.col(row_id).alias("id")).filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    # written once: the ranges are sampled from it and it is sorted, without making the keys twice
    rows = work.save(rows.select(F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("g"), "key", "id"), "keys")
    # the ranges are cut by 128 bits of the key and the id, so that no full key is sent to the driver
    ranged = rows.repartitionByRange("h", "g", "id").sortWithinPartitions("h", "g", "key", "id").select("key", "id")
    scanned = work.save(ranged.mapInArrow(_scan, _SCAN_SQL), "scan")
    work.drop("keys")
    # one row per partition: small whatever the data
    ends = scanned.filter("copy_id IS NULL")
    w = Window.orderBy("pid")
    linked = F.coalesce(F.col("first_key") == F.lag("last_key").over(w), F.lit(False))
    ends = ends.select("pid", "first_id", "head_id", "single", linked.alias("linked"))
    opens = F.when(~(F.col("linked") & F.col("single")), F.col("first_id"))
    carried = F.last(opens, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = work.save(ends.select("pid", "head_id", F.when(F.col("linked"), carried).alias("carried")).filter("carried IS NOT NULL"), "ends")
    inside = scanned.filter("copy_id IS NOT NULL").select("pid", "first_id", "copy_id", "in_first").join(F.broadcast(ends.select("pid", "carried")), "pid", "left")
    inside = inside.select(F.when(F.col("in_first"), F.coalesce("carried", "first_id")).otherwise(F.col("first_id")).alias("first_id"), "copy_id")
    return inside.unionByName(ends.select(F.col("carried").alias("first_id"), F.col("head_id").alias("copy_id")))


def activity_copies(activities: DataFrame) -> DataFrame:
    """Activities of one ledger_id that state the same title, venue and year in another layout."""
    full = filled(F.col("title")) & filled(F.col("venue")) & filled(F.col("year")) & F.col("ledger_id").isNotNull()
    key = F.concat_ws(BETWEEN, "ledger_id", plain_text_key(F.col("title")), any_order_key(F.col("venue")), year_key(F.col("year")))
    return copies_of_records(activities.filter(full), "activity_id", key)


def activity_records(activities: DataFrame) -> DataFrame:
    """One row per activity stated more than once: its representative and exact number of rows."""
    found = activity_copies(activities)
    return found.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("copies"))
