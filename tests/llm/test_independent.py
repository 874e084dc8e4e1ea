"""Versions written a second time, by direct formulas, of what SQL and libraries cannot check; and the registered queries."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import components, minhash_dedup, quality, substring_dedup, toxicity
from ledgerline.llm.fingerprints import BINS, BITS, fingerprints
from ledgerline.llm.minhash_dedup import _Tile, signatures, tile_links
from ledgerline.llm.queries import ORACLE_SQL, QUERIES
from ledgerline.llm.quality import STATISTICS, Discriminant, fit, quality_scores
from ledgerline.llm.substring_dedup import remove_repeats
from ledgerline.llm.textkit import mix, shingle_sets, texts_of
from ledgerline.llm.token_counts import Known, counter, token_counts
from ledgerline.llm.toxicity import Network, toxicity_scores, train
from ledgerline.llm.vocabulary import read

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(1)
    d, n = 4, (300, 200)
    x = [rng.normal(size=(n[0], d)) @ rng.normal(size=(d, d)), rng.normal(size=(n[1], d)) * [1, 2, 3, 0.5] + 1]
    moments = [np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for v in x]
    model = fit(np.array(n), np.stack([m[0, 1:] for m in moments]), np.stack([m[1:, 1:] for m in moments]))
    # directly: standardised, class covariances shrunk to the pooled one and to the identity
    every = np.concatenate(x)
    z = [(v - every.mean(axis=0)) / every.std(axis=0) for v in x]
    covariances = [np.cov(v.T, bias=True) for v in z]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
    point, logs = (rng.normal(size=(50, d)) * 2 - every.mean(axis=0)) / every.std(axis=0), []
    for c in (0, 1):
        few = min(1.0, 0.1 + 2 * d / (n[c] + 4 * d))
        s = (1 - few) * covariances[c] + few * pooled
        s = 0.99 * s + 0.01 * np.trace(s) / d * np.eye(d)
        off = point - z[c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off) - 0.5 * np.linalg.slogdet(s)[1] + np.log(n[c] + 1))
    expected = 1 / (1 + np.exp(-0.25 * (logs[1] - logs[0])))
    assert np.allclose(model.scores(point * every.std(axis=0) + every.mean(axis=0)), expected, atol=1e-9)


def test_statistics_by_hand():
    text = "The cat. The CAT\nsat! é 7\nsat! é 7"
    row = dict(zip(STATISTICS, quality.statistics(texts_of(pa.array([text])))[0], strict=True))
    words, size = re.findall(r"[^\x20\x09-\x0D]+", text), len(text.encode())
    lengths = np.array([len(w.encode()) for w in words])
    share = lambda n, of: np.log1p(of[1] * n / of[0])
    assert row["upper"] == pytest.approx(share(5, (size, 200))) and row["digit"] == pytest.approx(share(2, (size, 200)))
    assert row["beyond"] == pytest.approx(share(4, (size, 200))) and row["line"] == pytest.approx(share(2, (size, 200)))
    assert row["words"] == pytest.approx(np.log1p(len(words))) and row["word_length"] == pytest.approx(np.log1p(lengths.mean()))
    assert row["word_spread"] == pytest.approx(np.log1p(lengths.std()))
    assert row["distinct"] == pytest.approx(len(set(words)) / len(words) * np.log1p(len(words))) and row["most"] == pytest.approx(np.log1p(100 * 2 / len(words)))
    assert row["lone"] == pytest.approx(share(2, (len(words), 100))) and row["capital"] == pytest.approx(share(1, (len(words), 100)))
    assert row["marked"] == pytest.approx(share(2, (len(words), 100))) and row["line_again"] == pytest.approx(np.log1p(100 / 3))


def _forward(net: Network, texts: list[list[int]]) -> np.ndarray:
    """The network word by word, with plain loops."""
    out, f = [], toxicity._FILTERS
    for words in texts:
        rows = [*(net.embedding[net.rows[w]] for w in words), np.zeros(toxicity._DIM)]
        column, top = 0, []
        for w in toxicity._WIDTHS:
            values = []
            for p in range(len(rows)):
                at = [rows[p + o] if p + o < len(rows) else np.zeros(toxicity._DIM) for o in range(w)]
                values.append([sum(at[o] @ net.filters[:, column + o * f + k] for o in range(w)) for k in range(f)])
            top.append(np.max(values, axis=0))
            column += w * f
        out.append(np.maximum(np.concatenate(top) + net.bias, 0) @ net.weights + net.intercept)
    return np.array(out)


def _network(seed: int, words: int = 40) -> Network:
    rng = np.random.default_rng(seed)
    k = len(toxicity._WIDTHS) * toxicity._FILTERS
    rows = np.zeros(toxicity._BUCKETS, np.int32)
    rows[1 : words + 1] = 1 + np.arange(words)
    embedding = np.vstack([np.zeros(toxicity._DIM), rng.normal(size=(words, toxicity._DIM))])
    return Network(rows, embedding, rng.normal(size=(toxicity._DIM, sum(toxicity._WIDTHS) * toxicity._FILTERS)) * 0.3, rng.normal(size=k) * 0.1, rng.normal(size=k), -0.5)


def test_network_by_plain_loops():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 60, n).tolist() for n in (1, 2, 3, 7, 30, 0, 5)]
    flat = np.array([w for t in texts for w in t], np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(_network(3).logits(flat, bounds), _forward(_network(3), texts))


def test_a_logit_does_not_depend_on_the_texts_around():
    rng, net = np.random.default_rng(9), _network(5)
    texts = [rng.integers(0, 60, n) for n in (0, 1, 2, 5, 0, 0, 9)]
    for order in (range(7), range(6, -1, -1)):
        flat, bounds = np.concatenate([texts[i] for i in order]).astype(np.int32), np.concatenate([[0], np.cumsum([len(texts[i]) for i in order])])
        alone = [net.logits(texts[i].astype(np.int32), np.array([0, len(texts[i])]))[0] for i in order]
        assert np.allclose(net.logits(flat, bounds), alone)


def test_training_goes_down_the_gradient(monkeypatch):
    """One step of training against numeric gradients: every parameter moves against the sign of its own."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 30, 12).tolist() for _ in range(80)]
    y = np.array([float(3 in t) for t in texts])
    flat, bounds = np.array([w for t in texts for w in t], np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    before, own = train(flat, bounds, y, (int((y == 0).sum()), int(y.sum())), epochs=0)
    after, _ = train(flat, bounds, y, (int((y == 0).sum()), int(y.sum())), epochs=1, batch=1000)
    weight = np.array([(y == c).sum() / max((y == c).sum(), 1) for c in (0, 1)])[y.astype(int)]

    def loss(net: Network) -> float:
        z = _forward(net, [texts[i] for i in own])
        return float((weight[own] * (np.logaddexp(0, z) - y[own] * z)).mean())

    def slope(name: str, at) -> float:
        values = []
        for step in (1e-4, -1e-4):
            changed = Network(before.rows, before.embedding.astype(float), before.filters.astype(float), before.bias.astype(float), before.weights.copy(), before.intercept)
            if name == "intercept":
                changed.intercept += step
            else:
                own_ = getattr(changed, name).copy()
                own_[at] += step
                setattr(changed, name, own_)
            values.append(loss(changed))
        return (values[0] - values[1]) / 2e-4

    assert loss(after) < loss(before)
    moved = np.sign(slope("intercept", None)) == -np.sign(after.intercept - before.intercept)
    assert moved
    for name in ("weights", "bias", "filters", "embedding"):
        change = getattr(after, name).astype(float) - getattr(before, name).astype(float)
        places = [tuple(p) for p in np.argwhere(np.abs(change) > 1e-5)]
        picked = [places[i] for i in rng.permutation(len(places))[:12]]
        slopes = [slope(name, p) for p in picked]
        wrong = [p for p, s in zip(picked, slopes, strict=True) if abs(s) > 1e-4 and np.sign(s) == np.sign(change[p])]
        assert len(picked) > 3 and not wrong, (name, wrong)


def test_fingerprints_by_plain_sets(spark):
    """One-permutation MinHash a second time: bins, the order in which empty ones borrow, low bits, and likeness."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:300], *(f"x{i}" for i in range(100))]), " ".join(base[:60]), "one two", "", None, "A b C d E f", " ".join(rng.permutation(base))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        hashed[i] = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    every = sorted({s for v in hashed.values() for s in v})
    words = spark.createDataFrame([(k, list(s)) for k, s in enumerate(every)], "k int, s array<string>").select("k", F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    codes = words.select("k", F.when(F.size("h") == 5, F.xxhash64(*[F.get("h", F.lit(j)) for j in range(5)])).otherwise(F.xxhash64("h")).alias("x"))
    of = {every[r.k]: r.x for r in codes.collect()}
    order = {(r.j, r.b): r.x for r in spark.range(BINS).select(F.col("id").cast("int").alias("j")).crossJoin(spark.range(BINS).select(F.col("id").cast("int").alias("b"))).select("j", "b", F.xxhash64("j", "b").alias("x")).collect()}

    def code(i: int) -> list[int]:
        least: dict[int, int] = {}
        for s in set(hashed[i]):
            b = (of[s] >> (64 - 7)) + BINS // 2
            least[b] = min(least.get(b, 2**63), of[s])
        if not least:
            return []
        return [least[j if j in least else min(least, key=lambda b: order[j, b])] & (2**BITS - 1) for j in range(BINS)]

    rows = {r.doc_id: r for r in fingerprints(docs).collect()}
    own = {i: code(i) for i in hashed}
    for i, r in rows.items():
        assert r.fingerprint == bytes(own[i]).hex()
        after = own[(i - 1) % len(texts)]
        same = sum(a == b for a, b in zip(own[i], after, strict=False)) / BINS if own[i] and after else 0.0
        expected = 1.0 if not own[i] and not after else 0.0 if not own[i] or not after else min(1.0, max(0.0, (same - 2**-BITS) / (1 - 2**-BITS)))
        assert r.near_next == pytest.approx(expected)
    assert rows[4].edited_sha256 == hashlib.sha256(b"").hexdigest()


def test_tiles_lose_no_pair_near_the_threshold():
    """10,000 pairs of similarity 0.75 to 0.8 that share a band: each is linked in the first that it shares."""
    rng, m = np.random.default_rng(6), 112
    lost = pairs = 0
    for _ in range(100):
        size = int(rng.integers(60, 400))
        sets = []
        for _ in range(100):
            shared = mix(rng.integers(0, 2**63, size, dtype=np.uint64))
            apart = int(size * rng.uniform(0.118, 0.142))
            sets += [np.unique(np.concatenate([shared[: size - apart], mix(rng.integers(0, 2**63, apart, dtype=np.uint64))])) for _ in range(2)]
        h, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        signed = signatures(h, bounds, m)
        tile = _Tile.__new__(_Tile)
        tile.ids = tile.group = np.arange(len(sets))
        tile.signature, tile.sets, tile.sizes = signed, sets, np.diff(bounds)
        found: set = set()
        alike = (signed[0::2] == signed[1::2]).reshape(-1, 28, 4).all(axis=2)
        for band in sorted(set(alike.argmax(axis=1).tolist())):
            found |= set(tile_links(tile, tile, True, band, 4, 75))
        for k in range(0, len(sets), 2):
            both = len(np.intersect1d(sets[k], sets[k + 1], assume_unique=True))
            if 100 * both >= 75 * (len(sets[k]) + len(sets[k + 1]) - both) and alike[k // 2].any():
                pairs += 1
                lost += (k, k + 1) not in found
    assert pairs > 9000 and lost == 0


def test_hot_pivots_are_salted_alike(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SALTED", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:40], f"e{i}", *base[41:]])) for i in range(40)] + [(100 + i, " ".join(base)) for i in range(20)] + [(200, "quite another text of six words")]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 200 else 200 for i, _ in rows}


@pytest.mark.parametrize("local", [0, 100_000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()))
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == components.union_find(*map(list, zip(*proper, strict=True)))


def test_texts_under_one_id_do_not_join_their_groups(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = spark.createDataFrame([(1, b), (3, a), (3, f"{b} c")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(rows).collect()}
    assert got == {(1, 56, 1, True), (3, 56, 3, True), (3, 57, 1, False)}
    assert {(r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(rows).collect()} == {(1, b), (3, a)}


def test_heavy_minimisers_change_no_result(spark, monkeypatch):
    words = [f"w{i % 50}" for i in range(400)]
    rows = [(i, " ".join([f"a{i}", *words[i : i + 80], f"z{i}"])) for i in range(30)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "_heavy", lambda *a: np.ones(1 << 16, bool))
    assert sorted(map(tuple, remove_repeats(docs).collect())) == plain and sum(r[3] for r in plain) > 1000


def test_counts_with_a_small_memory_and_a_very_long_text():
    name = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(name), counter(read(name))
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'abcdefgh'[k % 8]}{rng.integers(0, 5000)}Wort" for k in range(n)) for n in (3000, 50, 9000, 50, 50)]
    texts += [texts[0], "nul\0 \0nul a\0", "x" * 5000, "<|endoftext|>a<|startoftext|>"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    kept, own.known = own.known, Known(1 << 10)
    try:
        for i in range(0, len(texts), 2):
            ids, first = own.ids(texts[i : i + 2])
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == expected[i : i + 2]
    finally:
        own.known = kept


ODD = "doc_id long, text string, quality int, toxic int, held_out string, score string, id string, n_tokens string"


def test_scores_and_counts_on_odd_rows(spark):
    """Repeated rows and ids, nulls, very long texts, columns named like those of results."""
    long = "very long text " * 60_000
    rows = [(1, "a b", 1, 0), (1, "a b", 1, 0), (1, "other text", 1, 0), (None, None, None, None), (2, "", 0, 1), (3, long, 0, 1), (4, " \n ", None, 1)]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ODD)
    for out in (quality_scores(docs, docs), toxicity_scores(docs, docs), token_counts(docs, tokenizer_path("word_bpe_49k.json"))):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 1, 1, 2, 3, 4]
    by_text: dict = {}
    for r in quality_scores(docs, docs, carry=("text",)).where("doc_id = 1").collect():
        by_text.setdefault(r.text, []).append(r.score)
    assert sorted(map(len, by_text.values())) == [1, 2] and all(len(set(x)) == 1 for x in by_text.values())


COLUMNS = {
    1: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    2: "doc_id bigint, held_out boolean, score double, predicted int",
    3: "doc_id bigint, held_out boolean, score double, predicted int",
    4: "page_id bigint, host string, path string, rule string, verdict string",
    5: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    6: "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    7: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    8: "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    9: "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    10: "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    11: "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    12: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    13: "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_has_the_columns_of_its_contract_and_equals_its_sql(spark, name):
    out = QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == COLUMNS[int(re.match(r"op(\d+)_", name)[1])]
    rows = out.collect()
    table = {4: "pages", 10: "embeddings"}.get(int(re.match(r"op(\d+)_", name)[1]), "documents")
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(out.columns[0]).collect()}
    assert "collocations" in name or {r[0] for r in rows} == ids and (len(rows) == len(ids) or "packing" in name)
    if name in ORACLE_SQL:
        duck = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, rows), key=str) == sorted(found.select(*out.columns).fetchall(), key=str)


def test_no_intermediate_table_is_left(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from ledgerline.llm.minhash_dedup import near_duplicates
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
assert near_duplicates(docs).count() == 3
import os
assert sum(n.startswith("ledgerline-") for n in os.listdir({str(tmp_path)!r})) <= 3
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
    assert [p.name for p in tmp_path.glob("ledgerline-*")] == []
