"""Rows that repeat id and text without bound are dealt to several batches, and lose what they repeat."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerline.llm import substring_dedup
from ledgerline.llm.substring_dedup import remove_repeats


def test_many_rows_of_one_id_and_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_BATCH_BYTES", 100_000)
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    own = " ".join(f"x{rng.randrange(10**6)}" for _ in range(50))
    half = " ".join(own.split()[:25])
    copies = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(passage).alias("text"), F.col("id").alias("_key"), F.lit("a").alias("N_Words"))
    empty = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("id").alias("_key"), F.lit("a").alias("N_Words"))
    others = spark.createDataFrame([(1, f"{own} {passage}", 0, "b"), (2, half, 0, "b")], copies.schema)
    docs = copies.unionByName(empty).unionByName(others)
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    parts = {r["_lots"] for r in substring_dedup._repeated(docs, key, "text", 10**6).collect()}
    assert len(parts) == 2 and max(parts) > 50
    out = remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "_key", "n_words", "n_removed"]
    found = out.cache()
    assert found.where("doc_id IS NULL").agg(F.count("*"), F.countDistinct("_key"), F.sum("n_removed"), F.max(F.length("text"))).first()[:] == (20_000, 20_000, 800_000, 0)
    assert found.where("doc_id = 7").agg(F.countDistinct("_key"), F.sum("n_words")).first()[:] == (3000, 0)
    assert {r.doc_id: (r.text, r.n_removed) for r in found.where("doc_id < 3").collect()} == {1: (own, 40), 2: (half, 0)}
