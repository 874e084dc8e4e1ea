"""How far pairs at the threshold are from being skipped, and that scratch tables go."""

from __future__ import annotations

from pathlib import Path

import numpy as np

import corpus_pipeline
from ledgerline.llm.fingerprints import fingerprints
from ledgerline.llm.minhash_dedup import signatures
from ledgerline.llm.substring_dedup import remove_repeats
from ledgerline.llm.toxicity import toxicity_scores


def test_no_pair_at_the_threshold_has_under_half_of_its_registers_equal():
    """op1's tiles skip pairs with under half of their 112 registers equal. Of pairs whose similarity is 0.75 exactly, none of 9,840 comes
    near: the shares of equal registers spread around 0.75, and the least is well over a half."""
    rng = np.random.default_rng(11)
    shares = []
    for size in (4, 8, 28, 100, 700):
        both, own = size * 3 // 4, size // 4
        for _ in range(2400 if size < 700 else 240):
            h = rng.integers(0, 2**64, both + own, dtype=np.uint64)
            a, b = np.sort(h[: both + own // 2]), np.sort(np.concatenate([h[:both], h[both + own // 2 :]]))
            registers = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 112)
            shares.append(float((registers[0] == registers[1]).mean()))
    share = np.array(shares)
    assert share.min() > 0.55 and abs(share.mean() - 0.75) < 0.005
    assert share.mean() - 5.5 * share.std() > 0.5


def _tables(spark) -> set[str]:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")
    return {p.name for p in Path(folder).glob("ledgerline-*")}


def test_tables_written_on_the_way_go(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for make, most in ((lambda: fingerprints(docs), 1), (lambda: toxicity_scores(docs, labels), 1), (lambda: remove_repeats(docs), 0), (lambda: corpus_pipeline.run(spark, folder), 1)):
        before = _tables(spark)
        assert make().count() > 0
        assert len(_tables(spark) - before) <= most
