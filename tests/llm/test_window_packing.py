"""Cuts against all ways to cut, pieces against the tokenizer library, and odd rows."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from ledgerline.llm import window_packing
from ledgerline.llm.queries import op12_window_packing
from ledgerline.llm.vocabulary import read, vocabulary
from ledgerline.llm.window_packing import Sentences, least_cuts, pack_windows

BYTES = tokenizer_path("byte_bpe_50k.json")


def padding(length: int, capacity: int) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


def least_of_all(places, penalty, capacity) -> list[tuple[int, int]]:
    """Least (cost, windows) that end at each place, by trying every window."""
    best = [(0, 0)]
    for j in range(1, len(places)):
        ways = [(best[i][0] + penalty[j] + padding(places[j] - places[i], capacity), best[i][1] + 1) for i in range(j) if places[j] - places[i] <= capacity]
        best.append(min(ways))
    return best


@pytest.mark.parametrize("capacity", [32, 48, 100])
def test_cuts_cost_the_least(capacity):
    rng = random.Random(capacity)
    for _ in range(120):
        places = np.cumsum([0, *(rng.randint(1, min(30, capacity)) for _ in range(rng.randint(1, 60)))])
        penalty = np.array([0, *(rng.choice([0, 3, 16, 64]) for _ in places[1:])])
        best = least_of_all(places.tolist(), penalty.tolist(), capacity)
        cuts, cost = least_cuts(places, penalty, capacity, True)
        sizes = np.diff(places[[0, *cuts]]).tolist()
        assert cuts[-1] == len(places) - 1 and max(sizes) <= capacity
        assert (cost, len(cuts)) == best[-1]
        assert cost == sum(padding(n, capacity) for n in sizes) + penalty[cuts].sum()
        cuts, cost = least_cuts(places, penalty, capacity, False)
        assert places[-1] - places[cuts[-1]] <= capacity
        assert cost == min(c for (c, _), p in zip(best[1:], places[1:], strict=True) if places[-1] - p <= capacity)


def test_sentences_end_between_tokens():
    library, sentences = Tokenizer.from_file(BYTES), Sentences(vocabulary(read(BYTES)))
    found = library.encode('He paid 3.50. "Why?" she asked!\nNext... line', add_special_tokens=False)
    ends = sentences.after(np.array(found.ids))
    assert ["".join(found.tokens[a:b]).replace("Ġ", " ").replace("Ċ", "\n") for a, b in zip([0, *ends], [*ends, None], strict=True)] == ["He paid 3.50.", ' "Why?"', " she asked!", "\n", "Next...", " line"]


def checked(rows, texts: dict, capacity: int = 2048) -> tuple[int, int]:
    """Every id in one piece, sequences gapless; padding and tokens."""
    library = Tokenizer.from_file(BYTES)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for ident, own in pieces.items():
        ids = np.array([*library.encode(texts[ident] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    lost = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        lost += padding(at, capacity)
    return lost, sum(r.length for r in rows)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["one", "two.", "three", "four!\n", "<|endoftext|>", "fünf", "日本。"]) for _ in range(n))
    texts = [None, "", " ", "word", "x" * 9000, "a b " * 4000, prose(12_000), *(prose(rng.randint(1, 600)) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length int, Sequence_Id string")
    for stretch in (1 << 19, 5000):  # few and many plans a partition
        monkeypatch.setattr(window_packing, "_STRETCH", stretch)
        lost, tokens = checked(pack_windows(docs.coalesce(1), BYTES).collect(), dict(enumerate(texts)))
        assert lost < 0.05 * tokens
    small = pack_windows(docs, BYTES, capacity=100, with_ids=True).collect()
    checked(small, dict(enumerate(texts)), 100)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in small)
    assert pack_windows(docs.where("false"), BYTES).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b c"), (1, "b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.start, r.length) for r in pack_windows(twice, BYTES).collect()) == [(0, 0, 2), (0, 0, 2), (1, 0, 3), (1, 0, 3)]


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    lost, tokens = checked(op12_window_packing(spark, folder).collect(), texts)
    assert lost < 0.01 * tokens
