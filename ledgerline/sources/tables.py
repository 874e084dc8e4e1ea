"""Parquet tables, logs that are only appended to, views, the schema ledger and JDBC."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_migration, version_of
from ..schemas import KEYS, LOGS, SCHEMA_VERSION
from .buckets import BucketedLog


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append(rows: DataFrame, path: str, schema: T.StructType, partition_by: Iterable[str] = ()) -> DataFrame:
    """Append rows in the columns of ``schema`` and return them as they were written: ids and times that rows make when
    they are computed are read back, not made again. Each append is a folder of its own, ``batch=<id>``."""
    out = rows.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in schema])
    folder = f"{path}/batch={uuid.uuid4().hex}"
    out.write.partitionBy(*partition_by).parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder).select(*schema.names)


def log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log's rows so far; a log that nothing was appended to is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*schema.names)


@dataclass(frozen=True)
class Store:
    """The logs of :data:`~ledgerline.schemas.LOGS` in one folder that the cluster shares, each bucketed by its key. Each
    log has one writer at a time, compaction included."""

    spark: SparkSession
    folder: str
    #: Batches of a bucket from which an append merges them.
    most: int = 64

    def log(self, name: str) -> BucketedLog:
        return BucketedLog(self.spark, f"{self.folder}/{name}", LOGS[name], KEYS[name])

    def table(self, name: str) -> DataFrame:
        return self.log(name).rows()

    def of(self, name: str, value: str) -> DataFrame:
        """The rows of one key; only its bucket is listed and read."""
        return self.log(name).of(value)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        return self.log(name).append(rows, self.most)


def register(views: Mapping[str, DataFrame]) -> None:
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)


def migration_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names and versions of the migration files in a folder, in order."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.where(is_migration(F.col("file"))).select("file", version_of(F.col("file")).alias("version")).orderBy("file")


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Files whose version is not in the ledger."""
    return files.join(applied.select("version"), "version", "left_anti").select("file", "version")


def migrate(spark: SparkSession, folder: str, ledger: str) -> list[str]:
    """Run the pending migration files of a folder in order and record each in the ledger, a log; returns their names.

    A file holds statements of Spark SQL, each ended by a semicolon at the end of a line. A file that fails is
    not recorded, and runs again from its beginning the next time: there are no transactions over tables."""
    waiting = pending(migration_files(spark, folder), log(spark, ledger, SCHEMA_VERSION)).orderBy("file").collect()
    for row in waiting:
        for statement in re.split(r";[ \t]*(?:\n|$)", spark.read.text(f"{folder}/{row['file']}", wholetext=True).first()[0]):
            if statement.strip():
                spark.sql(statement)
        append(spark.createDataFrame([(row["version"],)], "version string").withColumn("applied_at", F.current_timestamp()), ledger, SCHEMA_VERSION)
    return [r["file"] for r in waiting]


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """SQL texts of a folder, one statement a file."""
    read = spark.read.text(folder, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return read.select("file", F.trim("value").alias("statement"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    rows.write.mode("append").json(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table; with a numeric key it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, name: str, **options: str) -> None:
    rows.write.format("jdbc").mode("append").option("url", url).option("dbtable", name).options(**options).save()
