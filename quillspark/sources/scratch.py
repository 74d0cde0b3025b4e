"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local session gets a folder of its own; others fail."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A path there that nothing else uses; it goes when the application ends."""
    path = f"{scratch_root(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path
