"""Append-only logs bucketed by a key: one key's rows are in one folder, and few files hold them.

Rows lie in ``bucket=<n>/batch=<id>``, n being a checksum of the key modulo the number of buckets. Each append is a
batch of its own. Compaction merges the batches of a bucket: it writes the merged rows aside, then a marker that names the
batches they replace, and only then moves and deletes. A compaction that is cut off before its marker has
changed nothing; one that is cut off later is finished by the next, from the marker.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a file of a compacted bucket.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class BucketedLog:
    """A log with one writer at a time. The number of buckets belongs to the log and stays as it is. Readers that list files while a
    compaction moves them may see rows twice or not at all, and read again."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = 64

    def _place(self, *names: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _read(self, *paths: str) -> DataFrame:
        typed = T.StructType([*self.schema, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])
        return self.spark.read.schema(typed).option("basePath", self.path).parquet(*paths)

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col(self.key).cast("string").cast("binary")), F.lit(self.buckets)).cast("int")

    def bucket_of(self, value) -> int:
        return zlib.crc32(str(value).encode()) % self.buckets

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """All rows; a log that nothing was appended to is empty."""
        files, where = self._place()
        return self._read(self.path).select(*self.schema.names) if files.exists(where) and self.batches() else self._empty()

    def of(self, value) -> DataFrame:
        """The rows of one key. No other bucket is listed or read."""
        name = f"bucket={self.bucket_of(value)}"
        files, where = self._place(name)
        if not files.exists(where):
            return self._empty()
        return self._read(f"{self.path}/{name}").where(F.col(self.key) == F.lit(value)).select(*self.schema.names)

    def append(self, rows: DataFrame, most: int | None = None, batch: str | None = None) -> DataFrame:
        """Append rows in the columns of the schema and return them as they were written: ids and times that rows make when they
        are computed are read back, not made again. A key with very many rows is written by several tasks. With ``most`` the buckets with more
        batches than that are compacted afterwards, but for the new batch. A batch that is given a name replaces the one of that name."""
        if batch:
            for bucket, names in self.batches().items():
                if batch in names:
                    files, where = self._place(f"bucket={bucket}", f"batch={batch}")
                    files.delete(where, True)
        batch = batch or uuid.uuid4().hex
        typed = rows.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in self.schema]).withColumn("bucket", self._bucket()).withColumn("batch", F.lit(batch))
        typed.hint("rebalance", "bucket").write.partitionBy("bucket", "batch").mode("append").parquet(self.path)
        if most:
            self.compact(most, batch)
        written = [f"{self.path}/bucket={b}/batch={batch}" for b, names in self.batches().items() if batch in names]
        return self._read(*written).select(*self.schema.names) if written else self._empty()

    def batches(self) -> dict[int, list[str]]:
        """Names of the batches of each bucket."""
        files, where = self._place("bucket=*", "batch=*")
        out: dict[int, list[str]] = {}
        for found in files.globStatus(where) or []:
            place = found.getPath()
            out.setdefault(int(place.getParent().getName().partition("=")[2]), []).append(place.getName().partition("=")[2])
        return out

    def compact(self, most: int = 64, spare: str | None = None) -> list[int]:
        """Merge the batches, but for the batch ``spare``, of every bucket that has more than ``most`` of them, and finish what an earlier
        compaction has left; returns the buckets that were merged now."""
        self._finish()
        old = {b: [x for x in names if x != spare] for b, names in self.batches().items()}
        todo = {b: names for b, names in old.items() if len(names) > most}
        if not todo:
            return []
        name = uuid.uuid4().hex
        merged = self._read(*[f"{self.path}/bucket={b}/batch={x}" for b, names in todo.items() for x in names]).drop("batch")
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/_compaction/{name}")
        files, where = self._place("_compaction", f"{name}.json")
        stream = files.create(where, False)
        stream.write(bytearray(json.dumps({str(b): names for b, names in todo.items()}).encode()))
        stream.close()
        self._finish()
        return sorted(todo)

    def _markers(self) -> Iterable[str]:
        files, where = self._place("_compaction", "*.json")
        return [x.getPath().getName() for x in files.globStatus(where) or []]

    def _finish(self) -> None:
        for marker in self._markers():
            name = marker.removesuffix(".json")
            replaced = json.loads(self.spark.read.text(f"{self.path}/_compaction/{marker}", wholetext=True).first()[0])
            for bucket, names in replaced.items():
                files, made = self._place("_compaction", name, f"bucket={bucket}")
                if files.exists(made):
                    files.rename(made, self._place(f"bucket={bucket}", f"batch={name}")[1])
                for old in names:
                    files.delete(self._place(f"bucket={bucket}", f"batch={old}")[1], True)
            for left in (name, marker):  # the marker goes last
                files, where = self._place("_compaction", left)
                files.delete(where, True)
