"""Folders for tables that live as long as a session, where all machines of the cluster can read them, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder of ``spark.checkpoint.dir``; what is written there goes when the driver's JVM ends. Only a local
    session, whose tasks share the driver's disk, gets a folder of our own where none is named; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerline-")
        context.setCheckpointDir(found)
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def bound_arrow(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """Limit Arrow batches by bytes, so that a run of very long texts cannot fill a Python worker.

    Spark reads the setting when a query runs, which is after an operator has returned its DataFrame. So it stays
    set in the caller's session; a limit of the caller's own that is lower is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").rstrip("bB")
    if not now.isdigit() or int(now) > max_bytes:
        spark.conf.set(key, str(max_bytes))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or as many more underscores before it as no column of ``df`` has, case ignored."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
