"""Nearest vectors of many queries at once, exactly, in blocks.

Queries and rows are gathered into blocks of a few MB; each block of queries meets each block of rows in matrix
products of bounded size, and of each product only the best of every query go on. So no task holds more than a few blocks, and what is
shuffled is bounded by the number of queries, blocks and wanted neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import bound_arrow

#: Bytes of vectors in a block of rows and in one of queries, and numbers in an array that is made from both.
ROW_BYTES, QUERY_BYTES, NUMBERS = 4 << 20, 1 << 20, 1 << 19
#: Products closer than this to the last wanted one are computed again, one addend after the other.
_NEAR = 1e-9


def finite(vector: Column) -> Column:
    """Whether a vector has no null and no component that is not a finite number."""
    return F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums of the last axis from the first addend to the last, as a column expression adds them."""
    return np.cumsum(products, axis=-1)[..., -1]


def slices(count: int, width: int) -> Iterator[slice]:
    """Cuts ``count`` rows so that ``NUMBERS`` bounds what has ``width`` numbers for each."""
    step = max(1, NUMBERS // max(1, width))
    return (slice(at, at + step) for at in range(0, count, step))


def norms_of(v: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.sqrt(_in_order(v[s] * v[s])) for s in slices(*v.shape))]) if v.size else np.zeros(len(v))


def best_of(q: np.ndarray, q_norm: np.ndarray, rows: np.ndarray, norms: np.ndarray, ids: np.ndarray, k: int, fits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a few queries and of the ``k`` rows nearest to each, by score and then id, and their cosines. ``fits`` says which rows a
    query may take."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        scale, rough = np.multiply.outer(q_norm, norms), q @ rows.T
        good = np.isfinite(scale)
        np.divide(rough, scale, out=rough, where=scale != 0)
    rough[scale == 0] = 0.0
    good &= np.isfinite(rough)
    if fits is not None:
        good &= fits
    rough[~good] = -np.inf
    if len(ids) > k:
        good &= rough >= np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k, None] - _NEAR
    own, at = np.nonzero(good)
    score = np.zeros(len(own))
    for s in slices(len(own), q.shape[1]):
        scale_s = scale[own[s], at[s]]
        score[s] = np.where(scale_s == 0, 0.0, _in_order(q[own[s]] * rows[at[s]]) / np.where(scale_s == 0, 1.0, scale_s))
    order = np.lexsort((ids[at], -score, own))
    own, at, score = own[order], at[order], score[order]
    first = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[first], at[first], score[first]


def _compare(k: int):
    def vectors(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        v = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return v, norms_of(v)

    def allowed(asked: pa.StructArray, held: pa.StructArray):
        """Of some queries, which rows are in their cells."""
        known, cell = np.unique(held.field("cell").to_numpy(zero_copy_only=False), return_inverse=True)

        def fits(some: slice) -> np.ndarray:
            lists = asked.field("cells")[some]
            own, cells = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
            here = np.isin(cells, known)
            probed = np.zeros((len(lists), len(known)), dtype=bool)
            probed[own[here], np.searchsorted(known, cells[here])] = True
            return probed[:, cell]

        return fits

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1), strict=True):
                asked, held = asked.values, held.values
                (q, q_norm), (rows, norms) = vectors(asked), vectors(held)
                ids = held.field("id")
                names, fits = np.array(ids.to_pylist()), allowed(asked, held) if "cell" in held.type.names else None
                for s in slices(len(q), max(rows.shape)):
                    own, at, score = best_of(q[s], q_norm[s], rows, norms, names, k, fits and fits(s))
                    yield pa.RecordBatch.from_arrays([asked.field("id").take(pa.array(own + s.start)), ids.take(pa.array(at)), pa.array(score)], ["query", "id", "score"])

    return compare


def _blocked(table: DataFrame, keys: list[str], parts: Column, out: str, *more: str) -> DataFrame:
    """Rows (id, v, more) of each value of ``keys`` in ``parts`` lists by a hash of their id."""
    return table.withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int")).groupBy(*keys, "_part").agg(F.collect_list(F.struct("id", "v", *more)).alias(out))


def _bytes_in(lot: int) -> Column:
    """How many lots of so many bytes the vectors of a group make."""
    return F.greatest(F.lit(1), F.ceil(F.sum(F.size("v").cast("long")) * 8 / lot)).cast("int")


def _best(lots: DataFrame, stored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each query where lists of queries and of rows share ``keys``."""
    bound_arrow(lots.sparkSession)
    met = lots.join(stored, keys).select("asked", "held")
    kinds = {name: met.schema[name].dataType.elementType["id"].dataType for name in met.columns}
    out = T.StructType([T.StructField("query", kinds["asked"]), T.StructField("id", kinds["held"]), T.StructField("score", T.DoubleType())])
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return met.mapInArrow(_compare(k), out).withColumn("rank", best).where(F.col("rank") <= k)


def nearest_in_blocks(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Of queries (block, id, v, cells) and rows (block, id, v, cell): (query, id, score, rank) for the ``k`` nearest rows of each query
    among those of its cells. Vectors have one length. A query is in all blocks of its cells; a row is in one, and the rows of a block
    are few enough for one list."""
    asked = queries.groupBy("block").agg(_bytes_in(QUERY_BYTES).alias("lots"))
    lots = _blocked(queries.join(F.broadcast(asked), "block"), ["block"], F.col("lots"), "asked", "cells")
    stored = _blocked(rows, ["block"], F.lit(1), "held", "cell")
    return _best(lots.drop("_part"), stored.drop("_part"), ["block"], k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "id", query_vector: str = "embedding", row_id: str = "id", row_vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to each query by cosine: (query, id, score, rank), rank from 1 by score and then id.

    Exactly what :func:`~ledgerline.operators.memory.search_vector` gives for each: rows without a vector, of another length
    or with a component that is not finite are skipped, and a zero vector has score 0. Ids of queries should be
    different; rows that repeat an id are ranked each. A query without a usable vector, or with an empty one, finds nothing."""
    asked, held = (t.where(F.col(v).isNotNull() & finite(F.col(v)) & (F.size(v) > 0)).select(F.size(v).alias("length"), F.col(i).alias("id"), F.col(v).cast("array<double>").alias("v")) for t, i, v in ((queries, query_id, query_vector), (rows, row_id, row_vector)))
    # the bytes of all vectors of one length decide how many blocks they have
    blocks, parts = held.groupBy("length").agg(_bytes_in(ROW_BYTES).alias("blocks")), asked.groupBy("length").agg(_bytes_in(QUERY_BYTES).alias("lots"))
    stored = _blocked(held.join(blocks, "length"), ["length"], F.col("blocks"), "held").withColumnRenamed("_part", "block")
    meets = asked.join(parts, "length").join(blocks, "length").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _best(_blocked(meets, ["length", "block"], F.col("lots"), "asked"), stored, ["length", "block"], k)
