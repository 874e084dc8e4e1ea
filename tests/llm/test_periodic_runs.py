"""Periodic runs against plain loops, on odd rows, and the registered query against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm.periodic_runs import find_runs, periodic_runs, planes, stretches
from ledgerline.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w: list, least: int = 24, power: int = 3) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            own = w[start : i + q]
            if i > start and len(own) >= max(least, power * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((start, len(own), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("least", "power"), [(24, 3), (24, 2), (5, 3), (1, 4)])
def test_runs_equal_plain_loops(least, power):
    rng = random.Random(least * power)
    for _ in range(150):
        w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(260))]
        for _ in range(rng.randrange(4)):
            if len(w) > 30:
                a = rng.randrange(len(w))
                p = 1 + rng.randrange(1 + (len(w) - a) // 3)
                for i in range(a, min(len(w), a + rng.randrange(1, len(w)))):
                    w[i] = w[a + (i - a) % p]
        assert find_runs(np.array(w, np.int64), least, power) == plain_runs(w, least, power)


def test_long_periods_are_found_wherever_they_begin():
    for period in (8, 15, 16, 17, 31, 63, 64, 65, 127):
        for before in range(0, 140, 9):
            w = np.concatenate([np.arange(1000, 1000 + before), np.tile(np.arange(period), 3), [-5]]) + 5
            assert find_runs(w) == [(before, max(3 * period, 24), period)]
            assert find_runs(np.delete(w, before + 1)) == []


def test_stretches_are_maximal():
    ids = np.array([3, 1, 2, 1, 2, 1, 2, 9, 1, 2, 1, 2])
    assert stretches(planes(ids), len(ids), 2, 2) == [(1, 5), (8, 10)]
    assert stretches(planes(ids), len(ids), 2, 5) == []


def test_odd_rows_and_columns(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(9)}" for _ in range(4000)) + " " + "\n".join(["la", "li", "lu"] * 700)
    texts = [None, "", " \n\t", "one", " ".join(["again"] * 23), " ".join(["again"] * 24), "é 日 " * 12, long]
    rows = [(i if i % 3 else None, t, "kept", "gone") for i, t in enumerate([*texts, *texts])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best string, Runs string")
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "best", "runs", "collapsed"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        w = WORD.findall(r.text or "")
        expected = plain_runs(w)
        assert [tuple(x) for x in r.runs] == expected and r.collapsed == collapsed(w, expected)
    assert periodic_runs(docs.where("false")).count() == 0


def test_text_column_may_have_a_new_column_s_name(spark):
    docs = spark.createDataFrame([("a " * 30, 1)], "runs string, n int")
    row = periodic_runs(docs, text_col="runs").first()
    assert [tuple(x) for x in row.runs] == [(0, 30, 1)] and row.collapsed == "a"


def test_query_equals_its_contract(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, folder).collect()}
    some = 0
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = find_runs(np.unique(w, return_inverse=True)[1]) if len(w) > 2000 else plain_runs(w)
        some += len(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert found.pop(d.doc_id) == (d.doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    assert not found and some > 10
