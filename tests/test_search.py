"""Nearest vectors in blocks and by index against the exact search of one query."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import nearest as module
from ledgerline.operators import vector_index
from ledgerline.operators.memory import search_vector
from ledgerline.operators.nearest import nearest
from ledgerline.operators.vector_index import VectorIndex, fit

NAN, INF = float("nan"), float("inf")


def vectors(seed: int = 1, n: int = 300) -> list[tuple[int, list | None]]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [[c + rng.gauss(0, 0.2) for c in rng.choice(centres)] for _ in range(n)]
    rows += [rows[0]] * 40 + [[2 * x for x in rows[1]]] * 3  # copies, and one direction at two lengths
    odd = [None, [], [0.0] * 6, [1.0] * 5, [NAN] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [INF, 1.0, 1.0, 1.0, 1.0, 1.0], [1e200] * 6]
    return [*enumerate([*rows, *odd])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "id long, embedding array<double>").withColumn("tag", F.col("id") % 3)


@pytest.mark.parametrize("small", [False, True])
def test_nearest_equals_the_search_of_each_query(spark, table, monkeypatch, small):
    if small:
        monkeypatch.setattr(module, "ROW_BYTES", 1000)
        monkeypatch.setattr(module, "QUERY_BYTES", 500)
    queries = table.where("id % 25 = 0 OR id >= 340")
    found: dict = {}
    for r in nearest(queries, table, 20).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append((r.rank, r.id, r.score))
    for q in queries.collect():
        usable = q.embedding is not None and all(x is not None and math.isfinite(x) for x in q.embedding)
        expected = search_vector(table, q.embedding, 20).collect() if usable and q.embedding else []
        assert found.get(q.id, []) == [(i + 1, r.id, r.score) for i, r in enumerate(expected)]
    assert nearest(queries.where("false"), table, 3).count() == nearest(queries, table.where("false"), 3).count() == 0


def test_index_holds_every_row_and_reads_some_cells(spark, table, tmp_path):
    index = VectorIndex.build(table.where("id < 200"), str(tmp_path / "index"), cells=9)
    index.add(table.where("id >= 200"))
    usable = [i for i, v in vectors() if v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted(r.id for r in index.rows().select("id").collect()) == usable
    query = vectors()[7][1]
    exact = [(r.id, r.score, r.tag) for r in search_vector(table, query, 20).collect()]
    assert [(r.id, r.score, r.tag) for r in index.search(query, 20, 9).collect()] == exact
    few = index.search(query, 20, 2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert few.select(F.input_file_name()).count() == 20
    queries = table.where("id % 20 = 0 AND id < 300")
    assert index.recall(queries, 10, probes=9).first().recall == 1.0
    some = index.recall(queries, 10, probes=2).first()
    assert some.wanted == 150 and some.recall >= 0.9
    many = {(r.query, r.rank): (r.id, r.score) for r in index.search_many(queries, 5, probes=9).collect()}
    assert many == {(r.query, r.rank): (r.id, r.score) for r in nearest(queries, table, 5).collect()}
    assert index.search([1.0, 2.0, 3.0, 4.0, 5.0], 3, 2).count() == 0


def test_large_cells_are_written_in_bounded_files(spark, table, tmp_path, monkeypatch):
    from ledgerline.operators import vector_index

    monkeypatch.setattr(vector_index, "FILE_ROWS", 30)
    index = VectorIndex.build(table, str(tmp_path / "index"), cells=2)
    sizes = [r["count"] for r in index.rows().groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 30 and sum(sizes) == index.rows().count()


def test_an_index_needs_a_vector(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    with pytest.raises(ValueError, match="needs a vector"):
        VectorIndex.build(empty, str(tmp_path / "index"))


def test_centroids_are_units_without_empty_cells():
    v = np.random.default_rng(2).normal(size=(500, 8))
    c = fit(np.concatenate([v, v, np.zeros((3, 8))]), 40)
    assert np.allclose((c * c).sum(axis=1)[(c != 0).any(axis=1)], 1)
    assert len(np.unique((v @ c.T).argmax(axis=1))) >= 35
    assert len(fit(np.ones((10, 4)), 5)) == 1


def _peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_full_pair_of_blocks_needs_little_memory():
    rng, d = np.random.default_rng(3), 64
    lists = []
    for count in (module.QUERY_BYTES // 8 // d, module.ROW_BYTES // 8 // d):
        v = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * d, pa.int32()), pa.array(rng.normal(size=count * d)))
        rows = pa.StructArray.from_arrays([pa.array(np.arange(count)), v], ["id", "v"])
        lists.append(pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), rows))
    batch, seen = pa.RecordBatch.from_arrays(lists, ["asked", "held"]), []
    assert _peak(lambda: seen.extend(b.num_rows for b in module._compare(50)([batch]))) < 60  # 421 MB with all products at once
    assert sum(seen) == 50 * lists[0].value_lengths()[0].as_py()


def test_cells_of_a_batch_are_found_in_parts():
    rng = np.random.default_rng(4)
    v, centroids, found = rng.normal(size=(3000, 16)), rng.normal(size=(2000, 16)), []
    assert _peak(lambda: found.extend(best[:, 0] for _, best in vector_index._nearest_cells(v, centroids, 1))) < 30  # 45 MB is one number for each vector and cell
    assert np.array_equal(np.concatenate(found), (v @ centroids.T).argmax(axis=1))


@pytest.mark.parametrize("probes", [2, 30])
def test_small_and_large_cells_in_blocks(spark, table, tmp_path, monkeypatch, probes):
    index = VectorIndex.build(table, str(tmp_path / "index"), cells=30)
    largest = max(r["count"] for r in index.rows().groupBy("cell").count().collect())
    monkeypatch.setattr(module, "ROW_BYTES", (largest - 1) * 48)
    monkeypatch.setattr(module, "QUERY_BYTES", 200)
    first, parts = index._plan(30, 6)
    assert parts.max() == 2 and len(set(first)) < 30
    queries = table.where("id IN (0, 7, 120, 343, 346)")
    found: dict = {}
    for r in index.search_many(queries, 20, probes=probes).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append((r.id, r.score))
    assert found == {q.id: [(r.id, r.score) for r in index.search(q.embedding, 20, probes).collect()] for q in queries.collect() if q.embedding and len(q.embedding) == 6}
