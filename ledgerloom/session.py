"""Getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application, so that functions
    that run there find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    context.addPyFile(target)
    context._ledgerloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not hasattr(spark, "_ledgerloom_shared"):
        spark._ledgerloom_shared = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    return spark._ledgerloom_shared
