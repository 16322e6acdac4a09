"""The package on the executors: their Python workers import it by name."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_kinweave_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kinweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder, "src", root.name)
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder, root.name)), "zip", copy.parent, root.name))
    setattr(sc, _MARK, sc.applicationId)
