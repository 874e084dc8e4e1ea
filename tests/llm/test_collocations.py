"""Collocations against plain counting, the perfect hash, and the registered query against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerline.llm import collocations as module
from ledgerline.llm.collocations import collocations, count_by_slot, tree_sum
from ledgerline.llm.perfect_hash import PerfectHash
from ledgerline.llm.queries import ORACLE_SQL, op13_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least: int, top: int, inside: int = 50) -> list[tuple]:
    """Counts of all phrases by language, in Python."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        n, found = sum(a for p, a in own.items() if len(p) == 1), []
        longer: Counter = Counter()
        for p, a in own.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        for p, a in own.items():
            if len(p) > 1 and a >= least and not (p in longer and 100 * longer[p] >= inside * a):
                score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def corpus(seed: int) -> list[tuple[str | None, str | None]]:
    rng = random.Random(seed)
    words = ["A", "b", "a", "Éa", "é", "日本", "x'y", "b-c", "New", "york", "city"]
    rows: list[tuple[str | None, str | None]] = []
    for _ in range(300):
        w = [rng.choice(words[:8]) for _ in range(rng.randrange(20))]
        if rng.random() < 0.3:
            w += ["New", "York", *(["City"] if rng.random() < 0.7 else [])]
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " "]) for x in w)
        rows.append((rng.choice(["en", "en", "en", None, "und", "", "fr"]), text))
    return [*rows, ("en", None), (None, ""), ("en", " .,"), ("de", "a a a a a a a a a a a a a"), ("long", "p q r. " * 4000), *[("en", "same line here")] * 30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i % 7, t, lang, 1, "clash", "clash") for i, (lang, t) in enumerate(corpus(1))], "doc_id long, text string, lang string, Size int, phrase string, a string")


@pytest.mark.parametrize(("least", "top"), [(10, 2000), (3, 5), (1, 2000)])
def test_collocations_equal_plain_counts(docs, least, top):
    out = collocations(docs, least=least, top=top)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == plain(corpus(1), least, top)


def test_many_ranges_small_blocks_and_crowded_maps(docs, monkeypatch):
    monkeypatch.setattr(module, "_RANGE", 5000)
    monkeypatch.setattr(module, "_AT_ONCE", 300)
    monkeypatch.setattr(module, "_HEAVY", 20)
    expected = plain(corpus(1), 5, 2000)
    assert sorted(map(tuple, collocations(docs, least=5).collect())) == expected
    monkeypatch.setattr(module, "_bit_map", lambda names: b"\xff" * (1 << module._MAP - 3))
    assert sorted(map(tuple, collocations(docs, least=5).collect())) == expected


def test_empty_tables(spark, docs):
    assert collocations(docs.where("false")).collect() == []
    assert collocations(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).collect() == []


def test_perfect_hash_has_a_slot_for_each_key():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(0, max(n // 2, 1), n).astype(np.uint64), np.arange(n, dtype=np.uint32)
        table = PerfectHash(a, b)
        assert sorted(table.slots(a, b).tolist()) == list(range(n))
        assert (table.slots(a, b + np.uint32(n)) == -1).all()
        assert (table.slots(a + np.uint64(1 << 40), b) == -1).all()


def test_counts_by_slot_and_trees():
    rng = np.random.default_rng(4)
    blocks, expected = [], Counter()
    for _ in range(9):
        a = rng.integers(0, 400, 300).astype(np.uint64) << np.uint64(30)  # names that share all buckets
        b, n = (a % np.uint64(7)).astype(np.uint32), rng.integers(1, 4, 300).astype(np.uint32)
        blocks.append((a, b, n))
        for x, c in zip(a.tolist(), n.tolist(), strict=True):
            expected[x] += c
    a, b, f = count_by_slot(blocks, 10)
    assert dict(zip(a.tolist(), f.tolist(), strict=True)) == {x: c for x, c in expected.items() if c >= 10}
    for n in range(12):
        assert tree_sum((np.full(3, i) for i in range(n)), 3).tolist() == [n * (n - 1) // 2] * 3


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    found = duckdb.connect().sql(f"WITH documents AS (SELECT * FROM '{path}') SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_collocations']})").fetchall()
    rows = op13_collocations(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert sorted(map(tuple, rows)) == sorted(found) and found
