"""Connected components of an edge table: union-find inside partitions, star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def union_find(a: list, b: list) -> dict:
    """Each node of the edges (a[i], b[i]) with the least node of its component."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


#: Up to so many edges are a matter for one task.
LOCAL = 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch become one edge from each node to its root in that batch."""
    for batch in batches:
        nodes = union_find(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        u = np.fromiter(nodes.values(), np.int64, len(nodes))
        v = np.fromiter(nodes.keys(), np.int64, len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(u[u < v]), pa.array(v[u < v])], ["u", "v"])


def _contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for all edges of a partition together."""
    held = list(batches)
    if held:
        yield from _contract(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node is either a centre or in one edge as its larger end."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    seen = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return seen.where((F.col("leaf") > 1) | ((F.col("leaf") == 1) & (F.col("centre") == 1))).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for each node that an edge joins to another, component being its least node.

    Edges with a null end or two equal ends join nothing. Rounds of large-star and small-star halve the
    depth of the graph; each is a join and an aggregation on nodes, whose table never leaves the cluster. A graph of no
    more than ``LOCAL`` edges ends in one task by union-find, with the same result. The
    answer reads one table in the shared folder, which ``discard`` deletes."""
    flat = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v")))
    now = materialise(flat.mapInArrow(_contract, "u long, v long").distinct())
    if now.count() <= LOCAL:
        before, now = now, materialise(now.coalesce(1).mapInArrow(_contract_all, "u long, v long"))
        discard(before)
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where(F.col("u") < F.col("v")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where(F.col("u") < F.col("v")).distinct()
        before, now = now, materialise(small)
        discard(before)
    out = now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    out._scratch = now._scratch
    return out
