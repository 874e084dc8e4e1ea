"""Words, word hashes and shingles of many texts at once, as numpy arrays over Arrow's text buffer.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes are never part of
a longer character, so splitting bytes equals splitting characters. Hashes are 64 bit: a polynomial over
the bytes with random odd base, then an avalanche step. They are the same on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 2**64)
        _powers = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, inverse))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which each input bit moves half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts(NamedTuple):
    """Adjacent texts: ``data[offsets[i]:offsets[i + 1]]`` is text i."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def get(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(texts: Texts, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``max_bytes``, or of one row."""
    i = 0
    while i < texts.n:
        j = max(i + 1, int(np.searchsorted(texts.offsets, texts.offsets[i] + max_bytes, "right")) - 1)
        yield i, min(j, texts.n)
        i = min(j, texts.n)


def part(texts: Texts, i: int, j: int) -> Texts:
    at = texts.offsets
    return Texts(texts.data[at[i] : at[j]], at[i : j + 1] - at[i])


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    #: Words of text i are ``bounds[i]:bounds[i + 1]``.
    bounds: np.ndarray


def words_of(texts: Texts, between: np.ndarray = SPACE) -> Words:
    """Words by a table of the bytes that stand between them."""
    data, offsets = texts
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    space = between[data]
    word = ~space
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(word & (before | cut[:n]))
    before[:-1] = space[1:]
    before[-1] = True
    ends = np.flatnonzero(word & (before | cut[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, words: Words, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another salt gives another, independent hash."""
    powers, inverse = _power_tables(len(data) + 1)
    table = mix(_BYTE + np.uint64(salt)) if salt else _BYTE
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * powers[: len(data)], out=sums[1:])
    h = (sums[words.ends] - sums[words.starts]) * inverse[words.starts]
    return mix(h + (words.ends - words.starts).astype(np.uint64) * _STEP[63])


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values of ``h``: ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * powers[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n] + mix(np.array([k], np.uint64)))


def shingle_sets(texts: Texts, k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: sorted hashes and bounds. A text of fewer than k words has its
    whole word sequence as its one shingle; a text without words has none."""
    data = LOWER[texts.data] if lower else texts.data
    words = words_of(texts)
    h = word_hashes(data, words)
    grams, found, sizes = runs(h, k), [], np.zeros(texts.n, np.int64)
    for i in range(texts.n):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = runs(h[a:b], int(b - a))
        else:
            continue
        found.append(own)
        sizes[i] = len(own)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), bounds
