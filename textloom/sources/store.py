"""Tables that several steps read: written below the folder all executors share, deleted when the application ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none and all tasks run in the driver's process (tests) a
    folder of its own is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jsc = spark.sparkContext._jsc.sc()
        d = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), f"textloom-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, in a folder of the application that is deleted when it ends."""
    home = f"{shared_dir(spark)}/textloom-core/{spark.sparkContext.applicationId}"
    if home not in _homes:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _homes.add(home)
    return f"{home}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The table written once and read again: its lineage is cut, what follows reads columns it needs."""
    path = scratch(df.sparkSession, what)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
