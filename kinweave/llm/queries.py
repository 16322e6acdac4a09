"""Queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table as t
from .bpe import encoded
from .encodings import restored_documents
from .groups import match_groups
from .layouts import activity_copies, activity_records
from .leaks import leaked_items
from .lookalikes import lookalike_cells
from .names import variant_pairs
from .oracle import SQL
from .places import venue_places
from .survivors import FIELDS, artist_survivors, truths

__all__ = ["QUERIES", "SQL"]
Query = Callable[[SparkSession, str], DataFrame]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return match_groups(t(s, d, "merge_records"), "kept", "dropped", "ledger_id", "group_id")


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return variant_pairs(t(s, d, "artists"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return artist_survivors(t(s, d, "artists"))


def p3_truths(s: SparkSession, d: str) -> DataFrame:
    return truths(t(s, d, "artists"), "gy_id", FIELDS, ["source_type", "verification"])


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return activity_copies(t(s, d, "activities"))


def p4_records(s: SparkSession, d: str) -> DataFrame:
    return activity_records(t(s, d, "activities"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return venue_places(t(s, d, "activities"), "activity_id", "venue", t(s, d, "place_names")).withColumnRenamed("row_id", "activity_id")


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return lookalike_cells(t(s, d, "artists"), t(s, d, "activities")).select("src_table", "row_id", "field")


def p7_plain(s: SparkSession, d: str) -> DataFrame:
    return lookalike_cells(t(s, d, "artists"), t(s, d, "activities"))


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encoded(t(s, d, "documents"), "doc_id", "text")


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leaked_items(t(s, d, "documents"), "doc_id", "text", t(s, d, "eval_items"), "item_id", "text")


def p10_found(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = restored_documents(t(s, d, "documents"), "doc_id", "text")
    return got.select("doc_id", F.when(F.col("lost"), F.lit("")).otherwise(F.md5("restored")).alias("restored_md5"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_truths, p4_found, p4_records, p6_found, p7_found, p7_plain, p8_ids, p9_found, p10_found)}
