"""Intermediate tables in the folder that the cluster shares, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import bound_arrow as bound_arrow


#: Tables that :func:`materialise` has written in this session and nothing has deleted.
_written: list[DataFrame] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, whose tasks share the driver's disk, gets one of our
    own where it is unset; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerline-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts the lineage, and the
    copy outlives any executor. :func:`discard` deletes it; what a result still reads goes when the driver's
    JVM ends, whether or not the session was stopped before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _written.append(out)
    return out


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns, and delete the tables that were written to make it. Jobs of other threads must not
    write tables meanwhile."""
    before = list(_written)
    out = materialise(make())
    discard(*[df for df in _written if df is not out and not any(df is b for b in before)])
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            where, files = _place(df.sparkSession, path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)
            _written[:] = [x for x in _written if x is not df]


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or as many more underscores before it as no column of ``df`` has, case ignored."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
