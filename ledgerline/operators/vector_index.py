"""A persisted approximate index of vectors: an inverted file of cells around centroids.

Centroids are fitted by k-means on a bounded sample; every row is then stored in the cell of its nearest centroid, as
Parquet partitioned by cell. A search compares the query with the centroids, reads the nearest few cells alone and
ranks what they hold by the exact cosine; with all cells it is the exact search.

How many cells a search needs depends on the vectors: neighbours that are truly near are in the first cells, while those of
vectors without any structure are spread over all. :meth:`VectorIndex.recall` measures it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import bound_arrow
from .memory import search_vector
from . import nearest as blocks
from .nearest import finite, nearest, nearest_in_blocks, slices

#: Most vectors and bytes that centroids are fitted on, most cells, and most rows of a file.
SAMPLE, SAMPLE_BYTES, MOST_CELLS, FILE_ROWS = 20_000, 64 << 20, 4096, 200_000
_ROUNDS = 12


def _units(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1.0, norm)


def fit(vectors: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells by spherical k-means. A cell that loses all vectors takes the one that is
    farthest from its own centroid."""
    units = np.unique(_units(vectors), axis=0)
    cells = min(cells, len(units))
    centroids = units[np.sort(np.random.default_rng(seed).choice(len(units), cells, replace=False))]
    for _ in range(_ROUNDS):
        own = np.concatenate([(units[s] @ centroids.T).argmax(axis=1) for s in slices(len(units), cells)])
        best = (units * centroids[own]).sum(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = units[np.argsort(best)[: len(empty)]]
        moved = _units(sums)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def _nearest_cells(v: np.ndarray, centroids: np.ndarray, probes: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The ``probes`` nearest cells of some vectors at a time, so that nothing has a number for each vector and cell of a batch."""
    for s in slices(len(v), max(centroids.shape)):
        yield s, np.argsort(-(v[s].astype(np.float64) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder that the cluster shares: ``cells/cell=<n>/*.parquet`` and ``centroids``. It has one writer at a time."""

    spark: SparkSession
    path: str
    key: str = "id"
    vector: str = "embedding"

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Fit centroids and store all rows, with all their columns. The length of vectors is that of most rows in the sample; rows
        without a vector, of another length or with components that are not finite can't be found and are left out.

        The sample is at most ``SAMPLE`` rows and ``SAMPLE_BYTES``, those with the least hashes of their keys. Without ``cells`` there is one
        for about the square root of the rows, 4096 at most."""
        usable = rows.where(F.col(vector).isNotNull() & finite(F.col(vector)) & (F.size(vector) > 0))
        sizes = usable.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
        if sizes is None:
            raise ValueError("an index needs a vector")
        n = sizes["n"]
        cells = min(cells or int(np.ceil(np.sqrt(sizes["count"]))), MOST_CELLS)
        taken = usable.where(F.size(vector) == n).orderBy(F.xxhash64(key), key).limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * n))))
        sample = taken.select(F.col(vector).cast("array<double>").alias("v")).toArrow().column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        centroids = fit(sample.reshape(-1, n), cells)
        table = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, centroid array<double>")
        table.coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(rows.sparkSession, path, key, vector)
        index.add(rows)
        return index

    def centroids(self) -> np.ndarray:
        """By cell; at most ``MOST_CELLS`` rows."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows])

    def _fitting(self, rows: DataFrame, vector: str, n: int) -> DataFrame:
        """Rows whose vector fits the index."""
        return rows.where(F.col(vector).isNotNull() & (F.size(vector) == n) & finite(F.col(vector)))

    def add(self, rows: DataFrame) -> None:
        """Store more rows in the cells that there are. Files of a cell are bounded in rows, and a large cell is written by several tasks."""
        centroids = self.centroids()
        n = centroids.shape[1]
        source = self._fitting(rows, self.vector, n)
        at = source.columns.index(self.vector)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                cell = np.concatenate([np.zeros(0, dtype=np.int32), *(best[:, 0] for _, best in _nearest_cells(v, centroids, 1))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        bound_arrow(self.spark)
        celled = source.mapInArrow(placed, T.StructType([*source.schema, T.StructField("cell", T.IntegerType())]))
        sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files"))
        dealt = celled.join(F.broadcast(sizes), "cell").withColumn("_file", F.pmod(F.xxhash64(self.key), F.col("_files")))
        dealt.repartition("cell", "_file").drop("_files", "_file").write.partitionBy("cell").option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        """All rows, with their ``cell``."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, query: Sequence[float], limit: int | None = None, probes: int = 8) -> DataFrame:
        """The rows nearest to ``query`` among those of the ``probes`` nearest cells, with their exact ``score``; the other cells are
        not read. With as many probes as cells it is the exact search."""
        centroids = self.centroids()
        query = [float(x) for x in query]
        if len(query) != centroids.shape[1]:
            return search_vector(self.rows().drop("cell"), query, limit, self.vector, self.key)
        cells = np.argsort(-(centroids @ np.array(query)), kind="stable")[:probes].tolist()
        return search_vector(self.rows().where(F.col("cell").isin(cells)).drop("cell"), query, limit, self.vector, self.key)

    def _plan(self, cells: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell the first block of its rows and the number of these: small cells share a block, large ones have several."""
        counts = np.zeros(cells, dtype=np.int64)
        for r in self.rows().groupBy("cell").count().collect():  # at most MOST_CELLS
            counts[r["cell"]] = r["count"]
        most = max(1, blocks.ROW_BYTES // (8 * n))
        first, parts, block, held = np.zeros(cells, dtype=np.int32), -(-counts // most), 0, 0
        for cell, count in enumerate(counts.tolist()):
            if held and held + count > most:
                block, held = block + 1, 0
            first[cell] = block
            if count > most:
                block, held = block + int(parts[cell]), 0
            else:
                held += count
        return first, parts.astype(np.int32)

    def search_many(self, queries: DataFrame, k: int, query_id: str = "id", query_vector: str = "embedding", probes: int = 8) -> DataFrame:
        """The same for a table of queries: (query, id, score, rank). Blocks of the queries that probe some cells meet blocks of their rows."""
        centroids = self.centroids()
        n = centroids.shape[1]
        first, parts = self._plan(len(centroids), n)
        source = self._fitting(queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("v")), "v", n)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                for s, best in _nearest_cells(v, centroids, probes):
                    own, cell = np.repeat(np.arange(s.start, s.start + len(best)), best.shape[1]), best.ravel()
                    times = parts[cell]
                    own, cell, ends = np.repeat(own, times), np.repeat(cell, times), np.cumsum(times)
                    block = first[cell] + np.arange(len(cell)) - np.repeat(ends - times, times)
                    order = np.lexsort((block, own))
                    own, cell, block = own[order], cell[order], block[order]
                    new = np.flatnonzero(np.diff(own, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool))
                    ends = np.append(new[1:], len(own))
                    for few in slices(len(new), n):
                        lists = pa.ListArray.from_arrays(pa.array(np.append(new[few], ends[few][-1:]), pa.int32()), pa.array(cell, pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(block[new[few]], pa.int32()), *(c.take(pa.array(own[new[few]])) for c in batch.columns), lists], ["block", "id", "v", "cells"])

        bound_arrow(self.spark)
        kinds = T.StructType([T.StructField("block", T.IntegerType()), *source.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        plan = self.spark.createDataFrame(list(zip(range(len(first)), first.tolist(), parts.tolist(), strict=True)), "cell int, first int, parts int")
        rows = self.rows().select("cell", F.col(self.key).alias("id"), F.col(self.vector).cast("array<double>").alias("v"))
        held = rows.join(F.broadcast(plan), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
        return nearest_in_blocks(source.mapInArrow(asked, kinds), held, k)

    def recall(self, queries: DataFrame, k: int, query_id: str = "id", query_vector: str = "embedding", probes: int = 8, least: float = -1.0, exact: DataFrame | None = None) -> DataFrame:
        """One row: how many neighbours of score ``least`` or more the exact search has for the queries, how many of these the index
        finds, and the share. ``exact`` may hold what :func:`~ledgerline.operators.nearest.nearest` gives for them, so that several measures
        share one exact search."""
        if exact is None:
            exact = nearest(queries, self.rows(), k, query_id, query_vector, self.key, self.vector)
        exact = exact.where(F.col("score") >= least).select("query", "id")
        found = self.search_many(queries, k, query_id, query_vector, probes).select("query", "id", F.lit(1).alias("hit"))
        return exact.join(found, ["query", "id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
