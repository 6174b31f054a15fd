"""Makes the package importable on executors that do not have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_docstrata_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-docstrata-"), "docstrata.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._docstrata_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a local session (tests) gets one of its own; a cluster raises, as
    its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-docstrata-")
