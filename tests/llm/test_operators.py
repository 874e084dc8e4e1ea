"""Each operator against a brute-force version, and on nulls, empty tables, repeats, long texts and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe_codec import codec, decode, encode
from ledgerline.llm.embedding_dedup import linked, near_vectors
from ledgerline.llm.fingerprints import fingerprints
from ledgerline.llm.minhash_dedup import _signed, _Tile, drop_near_duplicates, near_duplicates, signatures, tile_links
from ledgerline.llm.packing import pack, plan
from ledgerline.llm.quality import quality_scores
from ledgerline.llm.substring_dedup import remove_repeats
from ledgerline.llm.textkit import shingle_sets, texts_of
from ledgerline.llm.token_counts import counter, token_counts
from ledgerline.llm.toxicity import toxicity_scores
from ledgerline.llm.url_filter import url_verdicts
from ledgerline.llm.vocabulary import read

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, id string, label int, score double, h long, n_tokens string"


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Prose, exact and near copies, shared passages, and what an operator may stumble on."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 120), 5000) for _ in range(12)]
    out: list[str | None] = list(base) + [base[0], base[0]]
    for i in range(8):
        words = base[1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        out.append(" ".join(words))
    passage = prose(rng, 60, 5000)
    out += [f"{prose(rng, 30, 5000)}\n{passage}\t{prose(rng, 10, 5000)}" for _ in range(4)]
    out += [None, "", "  \n ", "one two", "ONE Two", "x", "Grüße, 日本語 🙂 <|endoftext|> a", " ".join(["again"] * 90), prose(rng, 9000, 100_000), "é" * 3000]
    return [*enumerate(out), (None, "no id at all but some words here"), (3, base[3])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", 7, 0.5, 1, "clash") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> set:
    w = words((text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(nodes: list, edges) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates(docs, none):
    own = {i: shingles(t) for i, t in texts() if i is not None}
    edges = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])]
    expected = groups(list(own), edges)
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([i for i in own if expected[i] == i] + [3])
    assert near_duplicates(none).count() == 0


def test_large_buckets_lose_no_link(spark):
    """One base text with light and heavy edits: most copies link, some to few others and some to none."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = groups(list(sets), edges)
    assert len(set(expected.values())) > 3
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == expected


def test_tile_links_skip_what_an_earlier_band_shares():
    def tile(ids, signature):
        out = _Tile.__new__(_Tile)
        out.ids = out.group = np.array(ids)
        out.signature = np.array(signature, np.uint16)
        out.sets = [np.arange(10, dtype=np.uint64) for _ in ids]
        out.sizes = np.array([10] * len(ids))
        return out

    a = tile([1, 2], [[1, 2, 3, 4], [1, 2, 3, 4]])
    assert tile_links(a, a, True, 0, 2, 75) == [(1, 2)]
    assert tile_links(a, a, True, 1, 2, 75) == []


def test_tile_links_keep_what_an_earlier_band_only_seems_to_share():
    """Two texts that meet in band 3, and whose registers in an earlier one differ but in their low 16 bits."""
    own = [f"w7x{i}" for i in range(300)]
    rows = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [" ".join(own), " ".join([*own[:200], *(f"e{i}" for i in range(100))])]})
    h, bounds = shingle_sets(texts_of(rows.column(1)))
    a, b = signatures(h, bounds, 112)
    assert (a == b)[:4].tolist() == [False] * 3 + [True] and (a.astype(np.uint16) == b.astype(np.uint16))[:3].any()
    signed = next(_signed(112, 1)(iter([rows])))
    tile = _Tile(pa.StructArray.from_arrays([signed.column(0), signed.column(0), signed.column(1), signed.column(2)], ["rep", "c", "signature", "elements"]), 112)
    assert tile_links(tile, tile, True, 3, 1, 45, 0.3) == [(1, 2)]


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good = [(i, prose(rng, 60, 400).capitalize() + ".", 1) for i in range(0, 400, 2)]
    bad = [(i, " ".join(f"W{rng.randrange(99)}!!" for _ in range(60)), 0) for i in range(1, 400, 4)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    rows = {r.doc_id: r for r in quality_scores(table.select("doc_id", "text"), table.select("doc_id", "quality")).collect()}
    held = [(i, y) for i, _, y in good + bad if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in rows.items() if r.held_out} == {i for i, _ in held}
    assert sum(rows[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    assert quality_scores(docs, labels).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality_scores(none, labels).count() == 0
    assert quality_scores(docs, labels.limit(0)).count() == docs.count()


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        w = (["the", "of"] + prose(rng, 40, 300).split()) if i % 2 else (["der", "und"] + prose(rng, 40, 300).split())
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), "vile" if i % 2 else "gemein")
        rows.append((i, " ".join(w) + ".", toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held}
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity_scores(docs, labels).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity_scores(none, labels).count() == 0
    assert toxicity_scores(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_of_a_small_sample(spark):
    """A strong word in half of the toxic texts and a weak one in most of them, but in many clean ones too: at the
    true rate the best threshold takes the strong word alone, at one to two both."""
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        w, toxic = ["the", *prose(rng, 20, 40).split()], int(rng.random() < 0.08)
        for word, rates in (("vile", (0.005, 0.45)), ("rude", (0.15, 0.8))):
            if rng.random() < rates[toxic]:
                w.insert(rng.randrange(len(w)), word)
        rows.append((i, " ".join(w), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    small, whole = ({r.doc_id: r.predicted for r in toxicity_scores(table.select("doc_id", "text"), table.select("doc_id", "toxic"), sample=n).collect()} for n in (150, 10**6))
    assert sum(small[i] == whole[i] for i in whole) >= 0.97 * len(rows)
    assert 0.02 * len(rows) < sum(whole.values()) < 0.08 * len(rows)


def test_toxicity_with_labels_of_a_larger_corpus(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        w, toxic = prose(rng, 20, 40).split(), int(rng.random() < 0.3)
        rows.append((i, " ".join(w + ["vile"] * toxic), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").unionByName(spark.range(1000, 200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")))
    got = {r.doc_id: r.predicted for r in toxicity_scores(table.select("doc_id", "text"), labels, sample=100).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.97 * len(rows)


def test_urls(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("x.com", "", "block"), ("x.com", "", "allow"), (None, "/", "block")]
    urls = ["https://a.example.com/en/77?x#y", "HTTP://COM/en/", "http://Example.COM/en/8", "http://notcom/en/", "https://b.net/DE/", "https://b.net/de/1", "x.com/", None, "", "http://x.com?q", "http://x.com#en/", "s://com/en/\n", "a://b://com/en/", "http://" + "a." * 200 + "com/en/" + "z" * 5000]
    pages = spark.createDataFrame([(i % 9, u, "rule", "host") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, table).collect())
    assert got == Counter((i % 9, *judge(u)) for i, u in enumerate(urls))
    assert url_verdicts(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_verdicts(pages, table.limit(0)).collect()} == {"allow"}


def fuzz(n: int = 400) -> list[str]:
    rng = random.Random(9)
    signs = [*"abcdehlrstz  \n\t'.,!0179ÉßñΣσİ\u0301\u3000\x1c\x85日🙂aaaa", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "   ", " \n", "\r\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", "a" * 500, " " * 9, "\n\n a"]


def test_codec(spark, docs, none):
    library, own = Tokenizer.from_file(BYTES), codec(read(BYTES))
    for text in fuzz():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    rows = decode(encode(docs, BYTES), BYTES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert encode(none, BYTES).count() == 0
    again = encode(docs, BYTES, ids_col="n_tokens")
    assert again.columns == [*(c for c in docs.columns if c != "n_tokens"), "n_tokens"] and again.count() == docs.count()
    broken = spark.createDataFrame([(bytearray(np.array([119], "<u4").tobytes()),), (None,)], "token_ids binary")
    assert sorted(r.decoded for r in decode(broken, BYTES).collect()) == ["", library.decode([119])]


def test_token_counts(docs, none):
    library, own = Tokenizer.from_file(WORDS), counter(read(WORDS))
    some = fuzz()
    assert own.totals(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]
    for r, (_, text) in zip(sorted(token_counts(docs, WORDS).join(docs.select("doc_id", "text").distinct(), "doc_id").collect(), key=lambda r: r.doc_id), sorted((x for x in texts() if x[0] is not None), key=lambda x: x[0]), strict=True):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 2048)
    assert token_counts(docs, WORDS).count() == docs.count()
    assert token_counts(none, WORDS).count() == 0


def best_fit(histogram: dict[int, int], capacity: int) -> list[int]:
    """The room that is left in each sequence when pieces are placed one by one, longest first."""
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                rooms.append(capacity - length)
            else:
                rooms.remove(fit)
                rooms.append(fit - length)
    return rooms


def test_packing(docs, none):
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, text in texts():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            own = np.array(ids[k : k + 512], "<u4").tobytes()
            expected[i, k // 512, k, len(own) // 4, zlib.crc32(own)] += 1
    rows = pack(docs, WORDS, capacity=512, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for pieces in found.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert len(found) == len(best_fit(Counter(r.length for r in rows), 512))
    assert pack(none, WORDS).count() == 0


def test_plan_is_best_fit_and_complete():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([1, 5, 16, 100])
        histogram = {k: rng.randint(1, 40) for k in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
        rooms = best_fit(histogram, capacity)
        lines, used, ranks = plan(histogram, capacity), defaultdict(int), defaultdict(list)
        for length, first, count, each, sequence, offset in lines:
            for i in range(count):
                used[sequence + i // each] += length
                ranks[length].append(first + i)
                assert offset + i % each * length + length <= capacity
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        assert len(used) == len(rooms) and max(used.values()) <= capacity


def test_substrings(docs, none):
    rows = texts()
    starts = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    expected = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if starts[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        expected[i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)] += 1
    out = remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "id", "label", "score", "h", "n_tokens", "n_words", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()) == expected
    assert remove_repeats(none).count() == 0


def test_fingerprints(docs, none):
    table = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprints(table).collect()}
    own = {i: t or "" for i, t in texts() if i is not None}
    order = sorted(own, reverse=True)
    errors = []
    for k, i in enumerate(order):
        text, after = own[i], own[order[(k + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        errors.append(rows[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
        assert 0 <= rows[i].near_next <= 1
    assert max(map(abs, errors)) < 0.25 and abs(np.mean(errors)) < 0.05
    assert rows[0].fingerprint == rows[12].fingerprint != rows[1].fingerprint
    assert fingerprints(docs).count() == docs.count()
    assert fingerprints(none).count() == 0
    one = fingerprints(table.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        v = rng.normal(size=8)
        rows.append((i, v.tolist(), i % 3))
        if i % 4 == 0:
            rows.append((1000 + i, (v + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.3])).tolist(), i % 3))
        if i % 40 == 0:
            rows += [(2000 + i, v.tolist(), i % 3), (3000 + i, (2 * v).tolist(), i % 3)]
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 8, 0), (9003, [float("nan")] * 8, 0), (9004, [None, *[1.0] * 7], 0), (9005, [float("inf")] * 8, 0), (9006, [1.0] * 8, None), (9007, [1.0] * 8, None), (9008, [1.0, 2.0], 0), (9009, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, label int, rep string")
    usable = [(i, np.array(v), y) for i, v, y in rows] + [(9008, np.array([1.0, 2.0]), 0), (9009, np.array([2.0, 4.0]), 0)]
    links, edges = Counter(), []
    for a, (i, v, y) in enumerate(usable):
        for j, w, z in usable[:a]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
                links.update([i, j])
                edges.append((i, j))
    expected = groups([r[0] for r in rows + odd if r[0] is not None], edges)
    assert len(edges) > 50
    for tile in (1024, 16):
        got = near_vectors(table, tile=tile).collect()
        assert len(got) == len(rows) + len(odd)
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            else:
                assert (r.vec_id, r.n_links, r.component_id, r.kept) == (r.vec_id, links[r.vec_id], expected[r.vec_id], expected[r.vec_id] == r.vec_id)
    assert near_vectors(table.limit(0)).count() == 0


def test_bounds_drop_no_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 24)) * np.linspace(2, 0.1, 24)
    x[100:] = x[:100] + rng.normal(size=(100, 24)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    assert (linked(x, x, basis, 0.93) == (x @ x.T >= 0.93)).all()


def test_queries_have_the_columns_of_their_contract(spark):
    from ledgerline.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    out = QUERIES["op9_fingerprints"](spark, "/root/testdata/sf0.001")
    assert out.columns[:1] == ["doc_id"] and out.where(F.col("near_edited").between(0, 1)).count() == out.count()
