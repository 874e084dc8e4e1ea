"""Substring search by an index of character triples, which reads few of the texts.

Texts are dealt to ranges of about a hundred by a hash of their key and stored in the order of ranges, in small row groups. The
index says which triples of lower-case characters, as numbers, stand in which ranges. A text that holds a needle holds all its
triples, so only ranges that have all of them are read, and their texts are tested. Needles of fewer than three characters have no
triple: for them all texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import bound_arrow
from .memory import limit_of, search_text

#: Texts of a range, about, buckets of triples, bytes of a row group, and ranges that are named in a filter; more are joined.
RANGE, BUCKETS, GROUP_BYTES, NAMED = 100, 64, 1 << 20, 5000


def triples(text: Column) -> Column:
    """The different triples of neighbouring characters of a text in lower case."""

    def of(c: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - 2)), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2))))

    # as the variable of an outer function the characters are made once a text and not once a triple
    return F.get(F.transform(F.array(F.split(F.lower(text), "")), of), F.lit(0))


def _codes(text: Column) -> Column:
    """The triples of a text as numbers of three times 21 bits, as the index stores them."""
    point = lambda x, i: F.ascii(F.substring(x, i, 1)).cast("long")
    return F.transform(triples(text), lambda x: F.shiftleft(point(x, 1), 42) + F.shiftleft(point(x, 2), 21) + point(x, 3))


def _codes_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (range, text), texts in lower case: the different codes of the texts of a range in a batch."""
    for batch in batches:
        found: dict[int, list[np.ndarray]] = {}
        for where, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            points = np.frombuffer(text.as_buffer().to_pybytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(np.int64)
            if len(points) > 2:
                found.setdefault(where, []).append(np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
        for where, codes in found.items():
            codes = np.unique(np.concatenate(codes))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), where, dtype=np.int32)), pa.array(codes)], ["range", "triple"])


def _bucket(triple: Column) -> Column:
    return F.pmod(F.xxhash64(triple), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder that the cluster shares: ``texts`` with a column ``range``, and ``triples`` by bucket."""

    spark: SparkSession
    path: str
    key: str = "id"
    content: str = "content"

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "id", content: str = "content") -> TextIndex:
        """Store rows, with all columns but one named ``range``, and the triples of their texts. Rows with a null text are kept and never found."""
        index = cls(rows.sparkSession, path, key, content)
        ranges = -(-rows.count() // RANGE) or 1
        own = rows.drop("range").withColumn("range", F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"))
        own.hint("rebalance", "range").sortWithinPartitions("range").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/texts")
        bound_arrow(rows.sparkSession)
        lower = index.texts().where(F.col(content).isNotNull()).select("range", F.lower(F.col(content)).alias("text"))
        stored = lower.mapInArrow(_codes_in, "range int, triple long").distinct().withColumn("bucket", _bucket(F.col("triple")))
        stored.hint("rebalance", "bucket").sortWithinPartitions("bucket", "triple").write.partitionBy("bucket").parquet(f"{path}/triples")
        return index

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _ranges(self, needles: DataFrame) -> DataFrame:
        """Of each needle (needle) of three characters or more, the ranges that have all its triples."""
        wanted = needles.select("needle", _codes(F.col("needle")).alias("all")).where(F.size("all") > 0)
        asked = wanted.select("needle", F.size("all").alias("n"), F.explode("all").alias("triple")).withColumn("bucket", _bucket(F.col("triple")))
        held = self.spark.read.parquet(f"{self.path}/triples")
        return asked.join(held, ["bucket", "triple"]).groupBy("needle", "n", "range").agg(F.count("*").alias("found")).where("found = n").select("needle", "range")

    def candidates(self, needle: str) -> DataFrame:
        """The rows that a search for ``needle`` has to test."""
        asked = self.spark.createDataFrame([(needle,)], "needle string")
        own = asked.select(F.explode(_codes(F.col("needle"))).alias("triple")).withColumn("bucket", _bucket(F.col("triple"))).collect()
        if not own:
            return self.texts().drop("range")
        buckets, named = sorted({r["bucket"] for r in own}), [r["triple"] for r in own]
        held = self.spark.read.parquet(f"{self.path}/triples").where(F.col("bucket").isin(buckets) & F.col("triple").isin(named))
        ranges = held.groupBy("range").agg(F.count("*").alias("found")).where(F.col("found") == len(named)).select("range")
        few = [r["range"] for r in ranges.limit(NAMED + 1).collect()]
        if len(few) > NAMED:
            return self.texts().join(ranges, "range", "left_semi").drop("range")
        return self.texts().where(F.col("range").isin(few)).drop("range")

    def search(self, needle: str, limit: int | None = None, newest: str = "created_at") -> DataFrame:
        """What :func:`~ledgerline.operators.memory.search_text` gives, from the ranges that can hold the needle."""
        return search_text(self.candidates(needle), needle, limit, self.content, newest, self.key)

    def search_many(self, needles: DataFrame, limit: int | None = None, newest: str = "created_at") -> DataFrame:
        """The same for a table of different needles (needle): their rows with ``needle`` and ``rank``, from 1. Those of fewer than three
        characters go to every text, as one list."""
        read, low = self.texts(), F.lower(F.col(self.content))
        # as the variable of an outer function the text is put in lower case once and not once a needle
        holding = lambda names: F.explode(F.get(F.transform(F.array(low), lambda x: F.filter(names, lambda n: F.contains(x, F.lower(n)))), F.lit(0)))
        named = self._ranges(needles).groupBy("range").agg(F.collect_list("needle").alias("_named"))
        found = read.join(named, "range").withColumn("needle", holding(F.col("_named"))).drop("range", "_named")
        short = needles.where(F.size(triples(F.col("needle"))) == 0).agg(F.collect_set("needle").alias("_named"))
        found = found.unionByName(read.join(F.broadcast(short.where(F.size("_named") > 0))).withColumn("needle", holding(F.col("_named"))).drop("range", "_named"))
        rank = F.row_number().over(W.partitionBy("needle").orderBy(F.col(newest).desc(), F.col(self.key)))
        return found.withColumn("rank", rank).where(F.col("rank") <= limit_of(limit))
