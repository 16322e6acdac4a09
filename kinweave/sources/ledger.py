"""The archive's CSV tables: fixed string schemas, reads of missing files, atomic writes with backups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of each table in file order.
TABLES = {
    "artists": "ledger_id gy_id name_ko name_en aliases affiliation active_since country region category field cv_link_ok frame_status verification status source_url source_type collected_at reviewer_note updated_at",
    "activities": "activity_id ledger_id title venue year activity_type role source_url source_type collected_at publishable reviewer_note origin",
    "links": "link_id ledger_id label url link_type last_checked_at http_status page_title is_dead origin",
    "frame_membership": "ledger_id frame_code source_url collected_at attach_rule",
    "review_queue": "queue_id ledger_id reason detail status created_at",
    "collaborators": "collaborator_id name_ko name_en affiliation lab role source_url note",
    "collaborations": "collaboration_id ledger_id collaborator_id frame_code year topic source_url collected_at publishable origin",
    "cv_sources": "source_id ledger_id lang kind url fetch_url active last_pulled_at last_status last_changed_at content_sha256 snapshot_path note",
    "gy_retired": "gy_id merged_into_ledger_id retired_at",
    "scope": "ledger_id name scope criterion reason decided_by decided_at",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in TABLES[table].split()])


class Ledger:
    """Named tables under one folder. A missing file is an empty table; a missing column is null."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read(self, table: str) -> DataFrame:
        path, schema = f"{self.root}/{table}.csv", schema_of(table)
        if not self.exists(path):
            return self.spark.createDataFrame([], schema)
        raw = self.spark.read.options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False).csv(path)
        have = set(raw.columns)
        return raw.select(*[(F.col(f"`{c}`") if c in have else F.lit(None).cast("string")).alias(c) for c in schema.fieldNames()])

    def write(self, table: str, df: DataFrame, task: str, today: dt.date | None = None) -> str | None:
        """Replace a table: written beside, the old one moved to a dated backup (or aside, where the day has one), then renamed. Returns the backup.

        At every moment the table or its predecessor stands whole under some name.
        """
        path, cols = f"{self.root}/{table}.csv", schema_of(table).fieldNames()
        new = f"{self.root}/.{table}.new"
        df.select(*cols).write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="", emptyValue="").csv(new)
        backup, aside = None, None
        fs, live = self._fs(path)
        if self.exists(path):
            aside = f"{self.root}/backups/{table}.{(today or dt.date.today()).isoformat()}.{task}"
            if self.exists(aside):
                # the day's backup stays; the table is put aside until the new one is in its place
                aside = f"{self.root}/.{table}.old"
                fs.delete(self._fs(aside)[1], True)
            else:
                backup = aside
                fs.mkdirs(self._fs(aside)[1].getParent())
            if not fs.rename(live, self._fs(aside)[1]):
                raise OSError(f"{path} could not be put aside")
        if not fs.rename(self._fs(new)[1], live):
            if aside:
                fs.rename(self._fs(aside)[1], live)
            raise OSError(f"{path} could not be replaced")
        if aside != backup:
            fs.delete(self._fs(aside)[1], True)
        return backup

    def prune_backups(self, keep_days: int, today: dt.date | None = None) -> list[str]:
        """Delete backups older than ``keep_days``; the newest day of each table stays."""
        fs, p = self._fs(f"{self.root}/backups")
        if not fs.exists(p):
            return []
        found = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            table, day, _ = name.split(".", 2)
            found.append((table, dt.date.fromisoformat(day), name))
        newest = {}
        for table, day, _ in found:
            newest[table] = max(day, newest.get(table, day))
        limit = (today or dt.date.today()) - dt.timedelta(days=keep_days)
        old = sorted(n for t_, d_, n in found if d_ < limit and d_ != newest[t_])
        for n in old:
            q = self._fs(f"{self.root}/backups/{n}")
            q[0].delete(q[1], True)
        return old

    def counts(self) -> DataFrame:
        """(table, rows) of all tables."""
        out = None
        for name in TABLES:
            one = self.read(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
        return out


def without(df: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not among ``hidden``; null keys stay."""
    return df.join(hidden.select(key).distinct(), key, "left_anti")


def hidden_ids(artists: DataFrame, marks: tuple[str, ...] = ("HIDDEN", "HIDDEN_BY_REQUEST")) -> DataFrame:
    return artists.filter(F.col("status").isin(*marks)).select("ledger_id")
