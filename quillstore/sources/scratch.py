"""Folders for what lives as long as a job, where driver and executors both see them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which this sets only where it is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isEmpty():
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get()
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder's path."""
    return f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, older_than_s: float = 86_400) -> int:
    """Deletes the scratch folders that are older than this; the number deleted."""
    jvm, root = spark._jvm, scratch_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    now, n = jvm.System.currentTimeMillis(), 0
    for x in fs.listStatus(path) if fs.exists(path) else []:
        if x.getPath().getName().startswith("scratch-") and now - x.getModificationTime() > older_than_s * 1000:
            n += bool(fs.delete(x.getPath(), True))
    return n
