"""Sessions: what a job needs besides its tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark context, so that their Python functions can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_busframe_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="busframe-")), "busframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(path)
    sc._busframe_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; where that is unset, as in tests, a
    new temporary one), deleted when the session's JVM ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors share no folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
