"""Fixed-window quotas anchored at calls: a window begins at the first call that finds none open.

Where a window begins depends on all calls of its key before it. Time is cut into slices of ``SLICE`` windows, and a slice with
many calls of one key into equal parts, by a count made beforehand, so that a busy key is dealt to many tasks. Calls are shuffled
once, by key and slice, and sorted in their partitions; a task then walks its sorted calls in arrays, many keys at once. A
slice's effect is a step function from the time at which the open window ends to the window that is open
afterwards and the calls it has had. Step functions of stretches are put together to those of slices, and these are folded in order, one
small row a slice, so that each slice knows the window that it begins in.

Tasks read calls as a stream and hold one Arrow batch. A step function has at most as many steps as its slice has calls, and most
entries meet in the same chain, so it has few.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 16
#: A slice of more calls of one key than this, or than this share of all calls, is divided; so at most ``SHARE`` slices are.
CALLS, SHARE, MOST_PARTS = 200_000, 50_000, 100_000


def _bounds(batch: pa.RecordBatch) -> np.ndarray:
    """Where each key and slice begins in a sorted batch (columns key, slice), and its end."""
    n = batch.num_rows
    new = np.ones(n, bool)
    if n > 1:
        key, part = batch.column(0), batch.column(1).to_numpy()
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
    return np.append(np.flatnonzero(new), n)


def _lines(us: np.ndarray, begin: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The times of all groups on one ascending line, with room of two windows between groups, and where each begins."""
    base = np.arange(len(bounds) - 1) * ((SLICE + 2) * width)
    group = np.repeat(np.arange(len(base)), np.diff(bounds))
    return us - begin + base[group], base


def _pieces(bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The groups in runs whose line fits into 64 bits."""
    step = max(1, (1 << 62) // ((SLICE + 2) * width))
    for i in range(0, len(bounds) - 1, step):
        yield bounds[i : i + step + 1]


def step_functions(us: np.ndarray, begin: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each group of ascending times: how many steps it has, and of each step the last end of a window that enters by
    it, the start of the window that is open after the slice, and its calls so far."""
    line, base = _lines(us, begin, bounds, width)
    group = np.repeat(np.arange(len(base)), np.diff(bounds))
    end = bounds[1:]
    after, last = np.searchsorted(line, line + width), np.arange(len(line))
    for _ in range(SLICE):
        hop = after[last]
        last = np.where(hop < end[group], np.minimum(hop, len(line) - 1), last)
    # the open window began before the slice, so the next begins within the first width or at the call after it
    stop = np.minimum(end, np.searchsorted(line, base + width) + 1)
    entry = np.zeros(len(line) + 1, np.int64)
    np.add.at(entry, bounds[:-1], 1)
    np.add.at(entry, stop, -1)
    at = np.flatnonzero(np.cumsum(entry[:-1]) > 0)
    lead = last[at]
    keep = np.append(lead[1:] != lead[:-1], True)
    at, lead = at[keep], lead[keep]
    return np.bincount(group[at], minlength=len(base)), us[at], us[lead], end[group[at]] - lead


Steps = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def joined(first: Steps, then: Steps, width: int) -> Steps:
    """The step function (calls, until, leave, used) of two stretches, one after the other."""
    (n, until, leave, used), (m, until2, leave2, used2) = first, then
    at = np.searchsorted(until2, leave + width)
    held = at == len(until2)  # the window outlasts the second stretch
    at = np.minimum(at, len(until2) - 1)
    late = until2 > until[-1]
    until = np.concatenate([until, until2[late]])
    used = np.concatenate([np.where(held, used + m, used2[at]), used2[late]])
    leave = np.concatenate([np.where(held, leave, leave2[at]), leave2[late]])
    keep = np.append(leave[1:] != leave[:-1], True)
    return n + m, until[keep], leave[keep], used[keep]


def _steps(width: int) -> Callable:
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last group of a batch may go on in the next
        open_, key, begin = None, None, None

        def closed() -> pa.RecordBatch:
            n, *lists = open_
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([begin]), pa.array([n]), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists]], ["key", "slice", "n", "until", "leave", "used"])

        for batch in batches:
            timed = batch.filter(batch.column(2).is_valid())
            if not timed.num_rows:
                continue
            whole, us, part = _bounds(timed), timed.column(2).to_numpy(), timed.column(1).to_numpy()
            # of a group that goes on, the window that is open began before the first call here
            start = part.copy()
            goes_on = open_ is not None and (timed.column(0)[0].as_py(), int(part[0])) == (key, begin)
            if goes_on:
                start[: whole[1]] = us[0]
            found: list[tuple] = []
            for bounds in _pieces(whole, width):
                own = slice(bounds[0], bounds[-1])
                n, until, leave, used = step_functions(us[own], start[own], bounds - bounds[0], width)
                found.append((np.diff(bounds), n, until, leave, used))
            calls, n, until, leave, used = (np.concatenate(x) for x in zip(*found, strict=True))
            offsets = np.concatenate([[0], np.cumsum(n)])
            one = lambda i: (int(calls[i]), until[offsets[i] : offsets[i + 1]], leave[offsets[i] : offsets[i + 1]], used[offsets[i] : offsets[i + 1]])  # noqa: B023, E731
            low, high = 0, len(calls) - 1
            if goes_on:
                open_ = joined(open_, one(0), width)
                low = 1
                if high == 0:
                    continue
            if open_ is not None:
                yield closed()
            if low < high:
                rows = pa.array(whole[low:high])
                cut = slice(offsets[low], offsets[high])
                lists = [pa.ListArray.from_arrays(pa.array((offsets[low : high + 1] - offsets[low]).astype(np.int32)), pa.array(x[cut])) for x in (until, leave, used)]
                yield pa.RecordBatch.from_arrays([timed.column(0).take(rows), timed.column(1).take(rows), pa.array(calls[low:high]), *lists], ["key", "slice", "n", "until", "leave", "used"])
            open_, key, begin = one(high), timed.column(0)[-1].as_py(), int(part[-1])
        if open_ is not None:
            yield closed()

    return steps


def _chain(width: int) -> Callable:
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, used = None, None, 0
        for batch in batches:
            starts, counts = [], []
            for key, n, until, leave, had in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if key != now:
                    now, start, used = key, None, 0
                starts.append(start)
                counts.append(used)
                at = 0 if start is None else bisect_left(until, start + width)
                start, used = (leave[at], had[at]) if at < len(leave) else (start, used + n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["key", "slice", "start", "used"])

    return chain


def window_starts(us: np.ndarray, begin: np.ndarray, bounds: np.ndarray, width: int, start: np.ndarray, known: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each call in groups of ascending times, the start of its window and its number there, from 1. Where ``known``, a
    group begins in a window that began at ``start`` and has had ``used`` calls."""
    line, _ = _lines(us, begin, bounds, width)
    shift = line - us
    first, end = bounds[:-1], bounds[1:]
    after = np.minimum(np.searchsorted(line, line + width), np.repeat(end, end - first))
    cur = np.where(known, np.minimum(np.maximum(np.searchsorted(line, start + shift[first] + width), first), end), first)
    begins = np.zeros(len(us), bool)
    while True:
        cur = cur[cur < end]
        if not len(cur):
            break
        begins[cur] = True
        group = np.searchsorted(end, cur, "right")
        cur, end = after[cur], end[group]
    at = np.maximum.accumulate(np.where(begins, np.arange(len(us)), -1))
    group = np.repeat(np.arange(len(first)), np.diff(bounds))
    old = at < first[group]
    return np.where(old, start[group], us[np.maximum(at, 0)]), np.where(old, used[group] + np.arange(len(us)) - first[group], np.arange(len(us)) - at) + 1


def _assign(width: int) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_slice, open_start, open_used = None, None, 0, 0
        for batch in batches:
            valid = batch.column(2).is_valid()
            row, late = batch.column(3), pc.invert(valid)
            if pc.any(late).as_py():
                gone = row.filter(late)
                yield pa.RecordBatch.from_arrays([gone, pa.nulls(len(gone), pa.int64()), pa.nulls(len(gone), pa.int64())], ["row", "start", "used"])
                batch = batch.filter(valid)
            if not batch.num_rows:
                continue
            whole, us, part = _bounds(batch), batch.column(2).to_numpy(), batch.column(1).to_numpy()
            heads = pa.array(whole[:-1])
            start = batch.column(4).take(heads)
            known = start.is_valid().to_numpy(zero_copy_only=False).copy()
            start, used, begin = start.fill_null(0).to_numpy().copy(), batch.column(5).take(heads).to_numpy().copy(), part.copy()
            if (open_key, open_slice) == (batch.column(0)[0].as_py(), int(part[0])):  # the group goes on
                known[0], start[0], used[0] = True, open_start, open_used
            starts, numbers = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
            done = 0
            for bounds in _pieces(whole, width):
                own, g = slice(bounds[0], bounds[-1]), slice(done, done + len(bounds) - 1)
                starts[own], numbers[own] = window_starts(us[own], begin[own], bounds - bounds[0], width, start[g], known[g], used[g])
                done += len(bounds) - 1
            open_key, open_slice, open_start, open_used = batch.column(0)[-1].as_py(), int(part[-1]), int(starts[-1]), int(numbers[-1])
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(starts), pa.array(numbers)], ["row", "start", "used"])

    return assign


def json_key(keys: list[str]) -> Column:
    """One string for the values of some columns: different values, nulls included, have different strings."""
    return F.to_json(F.struct(*keys))


def decisions(calls: DataFrame, keys: list[str], at: str, ident: str, limit: int, window_ms: int) -> DataFrame:
    """Each call, with all its columns, and ``window_start``, ``used`` (calls of its window so far, this one included)
    and ``allowed``. Input columns of these three names give way.

    A window is half-open: a call exactly ``window_ms`` after its start begins the next. Denied calls neither use nor
    move a window. Calls at one time go by ``ident``. Calls without a time are denied; keys may be null and count
    as one key."""
    width = window_ms * 1000
    kept = [F.col(f"`{c}`") for c in calls.columns if c.lower() not in ("window_start", "used", "allowed")]
    timed = calls.select(json_key(keys).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.struct(*kept).alias("row"), F.col(ident).alias("ident"))
    long = SLICE * width
    slot = F.floor(F.col("us") / F.lit(long)) * long
    busy = _busy(timed.select("key", slot.alias("slot")))
    sliced = timed.withColumn("slot", slot).join(F.broadcast(busy), ["key", "slot"], "left")
    part = F.expr(f"slot + (((us - slot) * parts) div {long}) * {long} div parts")
    # both uses read the same columns by the same keys, so the calls are shuffled once
    dealt = sliced.select("key", F.coalesce(part, "slot").alias("slice"), "us", "row", "ident").repartition("key", "slice").sortWithinPartitions("key", "slice", "us", "ident")
    effects = dealt.mapInArrow(_steps(width), "key string, slice long, n long, until array<long>, leave array<long>, used array<long>")
    entered = effects.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(_chain(width), "key string, slice long, start long, used long")
    met = dealt.join(entered, ["key", "slice"], "left").sortWithinPartitions("key", "slice", "us", "ident").select("key", "slice", "us", "row", "start", "used")
    placed = met.mapInArrow(_assign(width), T.StructType([met.schema["row"], T.StructField("start", T.LongType()), T.StructField("used", T.LongType())]))
    return placed.select("row.*", F.timestamp_micros("start").alias("window_start"), F.col("used").cast("int").alias("used"), F.coalesce(F.col("used") <= limit, F.lit(False)).alias("allowed"))


def _busy(slots: DataFrame) -> DataFrame:
    """The slices of one key that are divided, ``SHARE`` at most, and into how many parts."""
    counts = slots.where("slot IS NOT NULL").groupBy("key", "slot").count()
    total = slots.agg(F.count("*").alias("total"))
    most = F.greatest(F.lit(CALLS), F.ceil(F.col("total") / SHARE))
    busy = counts.where(F.col("count") > CALLS).join(F.broadcast(total)).where(F.col("count") > most)
    return busy.select("key", "slot", F.least(F.lit(MOST_PARTS), F.ceil(F.col("count") / most)).cast("long").alias("parts"))


def quota_error(allowed: Column) -> Column:
    return F.when(~allowed, "QUOTA_EXCEEDED")
