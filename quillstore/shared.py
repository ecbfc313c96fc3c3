"""The folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


class NoSharedFolder(RuntimeError):
    """The session has several machines and names no folder that they share."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a local one where both are unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        found = f"file://{tempfile.gettempdir()}/quillstore-shared"
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on any file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
