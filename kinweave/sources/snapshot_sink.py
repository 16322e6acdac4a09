"""Publishing: result tables as JSON documents or parquet, committed as one set with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], kind: str = "parquet") -> dict:
    """Write the tables under ``root/version`` and, last of all, ``_MANIFEST.json`` with counts and digests.

    A reader takes versions with a manifest only, so a broken run publishes nothing.
    A version that is there already is an error.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{version}/_MANIFEST.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(f"version {version} is published already")
    manifest: dict = {"version": version, "tables": {}}
    for name, df in tables.items():
        at = f"{root}/{version}/{name}"
        df.write.mode("overwrite").format(kind).save(at)
        got = spark.read.schema(df.schema).format(kind).load(at)
        h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in got.columns])
        n, digest = got.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
        manifest["tables"][name] = {"rows": n, "digest": str(digest), "columns": got.columns}
    out = fs.create(path)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode("utf-8")))
    out.close()
    return manifest


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions in order of name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/_MANIFEST.json")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().getParent().getName() for s in (found or []))
