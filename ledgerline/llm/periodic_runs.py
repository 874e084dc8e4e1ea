"""Periodic runs of words by bit-parallel lags.

Words of a text are numbered, and bit b of all numbers is one big integer, a plane. For a lag q each plane is XORed
with itself shifted by q; the OR of these has a bit where words q apart differ. ANDing the complement with itself,
shifted by 1, 2, 4 ..., leaves a bit wherever a long enough stretch of equal words begins, and these stretches
are the runs of period q.

Not every lag is tried in a long text. A run of period q in [2^k, 2^(k+1)) is at least 3q long, so it holds a window of
2^k words that begins at a multiple of 2^k and begins again q later. Windows are numbered by doubling, and one
comparison of each sampled window with the next 2^k ones gives the lags of that range: n comparisons a range, which
lose no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_arrow, free_name
from .textkit import part, runs as hashed_windows, slices, texts_of, word_hashes, words_of

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
#: Lags below this are all tried.
_SHORT = 8


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every number, as one integer whose bit i belongs to number i."""
    bits = max(1, int(ids.max()).bit_length())
    rows = np.packbits(((ids[None, :] >> np.arange(bits)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def _ones(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def stretches(levels: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Where at least ``least`` consecutive positions agree with those ``lag`` later: first position and end."""
    differ = 0
    for plane in levels:
        differ |= plane ^ (plane >> lag)
    long = ((1 << (n - lag)) - 1) & ~differ
    width = 1
    while long and width < least:
        step = min(width, least - width)
        long &= long >> step
        width += step
    if not long:
        return []
    return [(int(a), int(b) + least) for a, b in zip(_ones(long & ~(long << 1)), _ones(long & ~(long >> 1)), strict=True)]


def _primes(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return [*found, q] if q > 1 else found


def _lags(rank: np.ndarray, size: int, most: int, found: list[tuple[int, int, int]]) -> list[int]:
    """Lags from ``size`` to ``2 * size - 1`` that a run can have, by the numbers ``rank`` of all windows of that many words.

    A window pair inside a known run of a shorter period tells nothing new: by the theorem of Fine and Wilf its lag
    would not be the smallest period."""
    rows = -(-len(rank) // size)
    padded = np.full((rows + 1) * size, -1, rank.dtype)
    padded[: len(rank)] = rank
    grid = padded.reshape(rows + 1, size)
    same = grid[1:] == grid[:-1, :1]
    if found:
        starts, ends = np.array([r[0] for r in found]), np.array([r[0] + r[1] for r in found])
        order = np.argsort(starts, kind="stable")
        reach = np.append(np.maximum.accumulate(ends[order]), -1)
        at = np.arange(rows) * size
        cover = reach[np.searchsorted(starts[order], at, "right") - 1]
        same &= (at + 2 * size)[:, None] + np.arange(size) > cover[:, None]
    lags = size + np.flatnonzero(same.any(axis=0))
    return lags[lags <= most].tolist()


def find_runs(ids: np.ndarray, least: int = 24, power: int = 3) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, period), by start and then period, of at least ``least`` numbers and ``power`` (2 or
    more) periods. The period is the smallest one."""
    n = len(ids)
    most = n // power
    if n < least:
        return []
    levels, found = planes(ids), []

    def tried(lag: int) -> None:
        for a, b in stretches(levels, n, lag, max(least, power * lag) - lag):
            shorter = (lag // p for p in _primes(lag))
            if not any(np.array_equal(ids[a : a + lag], ids[a + p : a + lag + p]) for p in shorter):
                found.append((a, b - a + lag, lag))

    for lag in range(1, min(_SHORT - 1, most) + 1):
        tried(lag)
    # two periods and a window must fit into a run whatever its place; else each lag is tried
    if power < 3:
        for lag in range(_SHORT, most + 1):
            tried(lag)
        return sorted(found, key=lambda r: (r[0], r[2]))
    rank, size = ids, 1
    while 2 * size <= most or size < _SHORT <= most:
        _, rank = np.unique(rank[:-size].astype(np.int64) * (int(rank.max()) + 1) + rank[size:], return_inverse=True)
        size *= 2
        if size >= _SHORT:
            for lag in _lags(rank, size, most, found):
                tried(lag)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _worked(texts: pa.Array, least: int, power: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Runs and the collapsed text of each text."""
    raw = texts_of(texts)
    for i, j in slices(raw):
        some = part(raw, i, j)
        words = words_of(some)
        hashes = word_hashes(some.data, words)
        windows = hashed_windows(hashes, _SHORT)
        for k in range(some.n):
            a, b = int(words.bounds[k]), int(words.bounds[k + 1])
            own = some.get(k).split()
            ids, known = np.zeros(0, np.int64), {}
            if b - a >= least:
                # a run of period 8 or more repeats 8 words; one of a shorter period has two equal words less than 8 apart
                h, w = hashes[a:b], windows[a : max(a, b - _SHORT + 1)]
                near = any((h[q:] == h[:-q]).sum() >= least - q for q in range(1, _SHORT))
                if near or len(np.unique(w)) < len(w):
                    ids = np.fromiter((known.setdefault(x, len(known)) for x in own), np.int64, len(own))
            found = find_runs(ids, least, power) if len(ids) else []
            if found:
                gone = np.zeros(len(own) + 1, np.int64)
                for start, length, period in found:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                own = [own[x] for x in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            yield found, b" ".join(own).decode()


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least: int = 24, power: int = 3) -> DataFrame:
    """Add the periodic runs of each text's words, and the text without their repetitions.

    Words are longest stretches without 0x20 and 0x09-0x0D, numbered from 0. A run is a stretch with smallest period q,
    where words q apart are equal, of at least ``least`` words and ``power`` times q, that no neighbouring word
    extends. ``runs_col`` holds (start, length, period) by start, then period; ``collapsed_col`` the words that no run
    contains after its first q words, joined by one space.

    A null, empty or blank text has no runs and an empty collapsed text. Ids are not looked at, so null and repeated ones
    do no harm, and each row is worked by itself, repeated or not. All columns stay; those with the names of the new ones, in
    any case of letters, give way. An empty table gives an empty one. A text is read whole in one task, in
    memory that grows with the longest text alone; nothing is shuffled."""
    if power < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    bound_arrow(docs.sparkSession)
    name = free_name(docs, "_source")
    taken = {runs_col.lower(), collapsed_col.lower()}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    source = docs.select(*kept, F.col(f"`{text_col}`").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for runs, text in _worked(batch.column(batch.num_columns - 1), least, power):
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(text)
            columns = [*batch.columns[:-1], pa.array(found, _RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], runs_col, collapsed_col])

    return source.mapInArrow(run, T.StructType([*source.schema[:-1], T.StructField(runs_col, RUNS), T.StructField(collapsed_col, T.StringType())]))


def strongest(runs: Column) -> Column:
    """The run with most periods, exactly; of equal ones the first. Null where there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, F.lit(None).cast(RUNS.elementType), lambda best, r: F.when(more(best, r), r).otherwise(best))
