from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm.quality import quality_scores
from ledgerline.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
        if name == "quality":
            gone = {r.doc_id for r in quality_scores(before, labels).where("predicted = 0").collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity_scores(before, labels).where("predicted = 1").collect()}
        if name in ("quality", "toxicity"):
            assert kept[name] == {r.doc_id for r in before.select("doc_id").collect()} - gone
        if name == "near_dedup":
            sets = {}
            for r in before.collect():
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
                sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
            parent = {i: i for i in sets}

            def root(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a in sets:
                for b in sets:
                    if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
            assert kept[name] == {i for i in sets if root(i) == i}
        if name == "substring_dedup":
            assert kept[name] == {r.doc_id for r in before.select("doc_id").collect()}
            w = [re.findall(r"\S+", r.text) for r in docs.collect()]
            assert sum(map(len, w)) <= sum(len(r.text.split()) for r in before.collect())
        if name != "packing":
            assert docs.columns == columns
    library, expected = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for r in before.collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            expected[r.doc_id, k // 4096, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect()) == expected


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c, d = (" ".join(words[i : i + 90]) for i in range(0, 400, 100))
    rows = [(1, a), (2, f"{a} x"), (2, b), (3, c), (3, c), (4, f"{d} y"), (4, d), (None, "one two"), (None, "one two")]
    out = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert Counter((i, t.removesuffix(" y")) for i, t in out) == Counter([(1, a), (2, b), (3, c), (4, d), (None, "one two")])


def test_a_rejected_text_takes_no_other_of_its_id(spark, tmp_path):
    good = " ".join(f"Plain words make sentence {i} here." for i in range(20))
    bad = "!!!! $$$$ #### " * 40
    rows = [(i, good if i % 2 else bad) for i in range(200)] + [(7, bad), (8, good), (None, bad), (None, good)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(200) if i not in (7, 8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r for r in rows if r[1] == good)


def test_stages_on_odd_rows(spark, tmp_path):
    """Columns named like those of operators, none of them lost or changed; nulls, repeats, and an empty table."""
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(words[100:160])
    rows = [(1, f"{passage} one two", "mine", "x", 7), (2, f"three four {passage}", "mine", "x", 7), (3, None, None, None, None), (None, "no id here", "y", "y", 1), (5, "", "z", "z", 2), (6, " ".join(words[200:260]), "q", "q", 3), (6, " ".join(words[200:260]), "q", "q", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _gone string, _hash int")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_words) for r in out.collect()) == Counter([(1, "one two", "mine"), (2, "three four", "mine"), (3, "", None), (None, "no id here", "y"), (5, "", "z"), (6, "", "q"), (6, "", "q")])
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter({*rows} - {rows[1]})  # the first two are near-duplicates
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and not Counter(map(tuple, kept.collect())) - Counter(rows)
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.packing(spark, docs, SF).collect()) == [0, 1, 2, 3, 5, 6, 6]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 100
