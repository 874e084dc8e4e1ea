"""Removal of passages that repeat anywhere in a corpus, by super-k-mers.

A window is ``width`` consecutive words of one text. Its minimiser is the least hash of the ``seed``-word
runs in it. Consecutive windows with one minimiser are a super-k-mer and travel as one packed string to the
bucket of the minimiser; equal windows have equal minimisers, so each bucket counts its windows for itself,
by sorting. Where a minimiser is very common, its windows are told apart by their minimiser over longer runs as well:
a histogram of minimisers over one text in sixteen plans this, and the plan changes no result.

Texts are dealt to batches by a hash of their id and text, and rows that repeat both very often to several. A batch sends a bucket one compressed block with
each different super-k-mer once (with a mark if the batch has it twice), so a passage that a third of
all texts share reaches its bucket once a batch. The bucket answers each batch with one bit a window. The
batch reads its texts again from the same shuffle files and removes the words that marked windows cover.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_arrow, free_name
from .textkit import Texts, mix, part, runs, slices, texts_of, word_hashes, words_of

_BATCH_BYTES, _BUCKET_BYTES, _MOST_PARTS = 8 << 20, 6 << 20, 20_000
#: Minimisers are counted by their top bits; of what is counted, one text in so many is read.
_CELL_BITS, _ONE_IN = 16, 16
#: Bytes that a row counts beside its text, and the share of all bytes from which rows that repeat id and text are divided: at most so
#: many different ones are.
_ROW_BYTES, _SHARE = 100, 50_000


def _least_of(h: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values."""
    span = 1
    while 2 * span <= k and len(h) > span:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = k - span
    return np.minimum(h[:-rest], h[rest:]) if rest and len(h) > rest else h[: max(0, len(h) - rest)]


def _longer(width: int, seed: int) -> int:
    return max(seed, width // 2)


def super_kmers(texts: Texts, width: int, seed: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of adjacent texts: minimiser, number of the first word, number of windows, and the word bounds of texts. Where
    the top bits of a minimiser are ``heavy``, it is mixed with the minimiser over longer runs."""
    words = words_of(texts)
    h = word_hashes(texts.data, words)
    least = _least_of(runs(h, seed), width - seed + 1)
    n = len(least)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, words
    if heavy is not None:
        common = heavy[(least >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
        if common.any():
            long = _longer(width, seed)
            least = np.where(common, mix(least ^ mix(_least_of(runs(h, long), width - long + 1))), least)
    inside = np.zeros(n + 1, np.int64)
    first, last = words.bounds[:-1], words.bounds[1:] - width + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    inside = np.cumsum(inside[:n]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True)) + 1
    return least[starts], starts, stop - starts, words


def _histogram(width: int, seed: int) -> Callable:
    """Windows by the top bits of their minimiser, one row a cell and partition."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _CELL_BITS, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for i, j in slices(texts):
                minimiser, _, n, _ = super_kmers(part(texts, i, j), width, seed)
                counts += np.bincount((minimiser >> np.uint64(64 - _CELL_BITS)).astype(np.int64), weights=n, minlength=len(counts)).astype(np.int64)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    return histogram


def _heavy(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, buckets: int) -> np.ndarray:
    """The cells with more than eight times the windows of a mean bucket and of a mean cell; at most 65,536 numbers come here."""
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(_ONE_IN)) == 0).select(text_col)
    rows = some.mapInArrow(_histogram(width, seed), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << _CELL_BITS, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return counts > max(8 * counts.sum() / min(buckets, len(counts)), 1000)


def _ordered(table: pa.Table) -> pa.Table:
    """The batch in one order, whatever the order in which its rows came."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def _survey(texts: Texts, width: int, seed: int, buckets: int, heavy: np.ndarray):
    """Walk a batch: word counts, and for each bucket the different super-k-mers in order of appearance,
    each with its places (first word within the batch)."""
    counts, by_bucket, at = np.zeros(texts.n, np.int64), {}, 0
    for i, j in slices(texts):
        own = part(texts, i, j)
        minimiser, starts, n, words = super_kmers(own, width, seed, heavy)
        counts[i:j] = np.diff(words.bounds)
        data = own.data.tobytes()
        begin, end = words.starts[starts].tolist(), words.ends[starts + n + width - 2].tolist() if len(starts) else []
        for b, s, e, w, k in zip((minimiser % np.uint64(buckets)).tolist(), begin, end, starts.tolist(), n.tolist(), strict=True):
            found = by_bucket.setdefault(b, {})
            places = found.setdefault(data[s:e], (k, []))
            places[1].append(at + w)
        at += len(words.starts)
    return counts, by_bucket


def _blocks(width: int, seed: int, buckets: int, heavy: np.ndarray) -> Callable:
    def send(table: pa.Table) -> pa.Table:
        batch = table.column("_batch")[0].as_py()
        table = _ordered(table)
        _, found = _survey(texts_of(table.column("_text")), width, seed, buckets, heavy)
        pack = zstandard.ZstdCompressor(level=3)
        rows = []
        for b, own in found.items():
            sizes = np.fromiter(map(len, own), np.uint32, len(own))
            twice = np.fromiter((len(p) > 1 for _, p in own.values()), np.uint8, len(own))
            rows.append((b, pack.compress(b"".join([np.uint32(len(own)).tobytes(), sizes.tobytes(), twice.tobytes(), *own]))))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "block": pa.array([x for _, x in rows], pa.binary())})

    return send


def _count(width: int) -> Callable:
    def count(table: pa.Table) -> pa.Table:
        unpack, pieces, twice, sizes, per = zstandard.ZstdDecompressor(), [], [], [], []
        for block in table.column("block").to_pylist():
            raw = unpack.decompress(block)
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            sizes.append(np.frombuffer(raw, np.uint32, n, 4))
            twice.append(np.frombuffer(raw, np.uint8, n, 4 + 4 * n))
            pieces.append(np.frombuffer(raw, np.uint8, offset=4 + 5 * n))
            per.append(n)
        texts = Texts(np.concatenate(pieces), np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]))
        one, two, windows = [], [], []
        for i, j in slices(texts):
            own = part(texts, i, j)
            words = words_of(own)
            n = np.diff(words.bounds) - width + 1
            # a window's place: every word of a super-k-mer but the last width - 1
            inside = np.ones(len(words.starts), bool)
            late = (words.bounds[1:, None] - 1 - np.arange(width - 1)[None, :]).ravel()
            inside[late] = False
            at = np.flatnonzero(inside)
            one.append(runs(word_hashes(own.data, words), width)[at])
            two.append(runs(word_hashes(own.data, words, salt=1), width)[at])
            windows.append(n)
        one, two, windows = np.concatenate(one), np.concatenate(two), np.concatenate(windows)
        # 128 bits name a window: sort by the first half, then tell apart what shares it
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
            same = a[1:] == a[:-1]
        same &= b[1:] == b[:-1]
        again = np.repeat(np.concatenate(twice) > 0, windows)
        group = np.concatenate([[0], np.cumsum(~same)])
        group_size = np.bincount(group, weights=1 + again[order])
        marks = np.zeros(len(one), bool)
        marks[order] = group_size[group] > 1
        ends = np.cumsum(windows)[np.cumsum(per) - 1]
        pack = zstandard.ZstdCompressor(level=1)
        out = [(t, pack.compress(np.packbits(m).tobytes())) for t, m in zip(table.column("batch").to_pylist(), np.split(marks, ends[:-1]), strict=True) if m.any()]
        return pa.table({"batch": pa.array([t for t, _ in out], pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int64()), "marks": pa.array([m for _, m in out], pa.binary())})

    return count


def _cut(width: int, seed: int, buckets: int, heavy: np.ndarray) -> Callable:
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _ordered(left)
        texts = texts_of(left.column("_text"))
        marks = dict(zip(right.column("bucket").to_pylist(), right.column("marks").to_pylist(), strict=True))
        counts, found = _survey(texts, width, seed, buckets if marks else 1, heavy)
        delta = np.zeros(int(counts.sum()) + 1, np.int32)
        unpack = zstandard.ZstdDecompressor()
        for bucket, block in marks.items():
            own = found[bucket]
            bits = np.unpackbits(np.frombuffer(unpack.decompress(block), np.uint8)).astype(bool)
            at = 0
            for n, places in own.values():
                hit = bits[at : at + n]
                at += n
                if hit.any():
                    where = np.flatnonzero(hit)
                    for p in places:
                        delta[p + where] += 1
                        np.subtract.at(delta, p + where + width, 1)
        gone = np.cumsum(delta[:-1]) > 0
        bounds = np.concatenate([[0], np.cumsum(counts)])
        kept, removed = [], []
        for i in range(texts.n):
            own = gone[bounds[i] : bounds[i + 1]]
            words, n = texts.get(i).split(), int(own.sum())
            removed.append(n)
            kept.append(b" ".join(itertools.compress(words, (~own).tolist()) if n else words))
        return pa.table({"_rest": left.column("_rest"), "_kept": pa.array(kept, pa.binary()).cast(pa.string()), "_words": pa.array(counts), "_removed": pa.array(removed, pa.int64())})

    return cut


def _repeated(docs: DataFrame, key: Column, text_col: str, total: int) -> DataFrame:
    """Keys (_key) of rows that repeat id and text and would fill a batch, ``_SHARE`` at most, and the batches (_lots) that they need."""
    limit = max(_BATCH_BYTES, total // _SHARE)
    sizes = docs.select(key.alias("_key"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + _ROW_BYTES).alias("n")).groupBy("_key").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    return sizes.where((F.col("rows") > 1) & (F.col("n") > limit)).select("_key", F.least(F.col("rows"), F.ceil(F.col("n") / limit)).alias("_lots"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, seed: int = 4, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """Remove each word that a ``width``-word window covers whose words also start somewhere else, in the
    same text or another. Windows are judged on the input, not on what is left.

    Returns the input's columns, ``text_col`` with the kept words joined by one space, and two counts. A
    column of the input that has the name of a count gives way to it. A null text gives an empty one and
    counts of 0; a null id is an id like any other; repeated rows repeat each other and lose their passages, be they very many;
    an empty table gives an empty one. Names of other columns may be any. A text is walked whole in one task. Windows count as equal when two independent 64-bit hashes over
    all their words are.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    columns = [c for c in docs.columns if c.lower() not in (n_words.lower(), n_removed.lower())]
    rest = [c for c in columns if c != text_col]
    total, count = (x or 0 for x in docs.select(F.sum(F.octet_length(text_col)), F.count("*")).first())
    batches, buckets = -(-total // _BATCH_BYTES) + 1, -(-3 * total // _BUCKET_BYTES) + 1
    parts = min(_MOST_PARTS, 2 * batches)
    heavy = _heavy(docs, id_col, text_col, width, seed, buckets)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    # rows of one id and text are alike, so that it does not matter which of them goes to which batch
    own, lots = free_name(docs, "_key"), free_name(docs, "_lots")
    lot = F.pmod(F.monotonically_increasing_id(), F.col(lots))
    named = docs.withColumn(own, key).join(F.broadcast(_repeated(docs, key, text_col, total + _ROW_BYTES * count).toDF(own, lots)), own, "left")
    batch = F.pmod(F.when(F.col(lots) > 1, F.xxhash64(own, lot)).otherwise(F.col(own)), F.lit(batches))
    dealt = named.select(batch.alias("_batch"), F.col(id_col).cast("string").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest")).repartition(parts, "_batch")
    blocks = dealt.groupBy("_batch").applyInArrow(_blocks(width, seed, buckets, heavy), "bucket long, batch long, block binary")
    answers = blocks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_count(width), "batch long, bucket long, marks binary")
    kinds = T.StructType([T.StructField("_rest", dealt.schema["_rest"].dataType), T.StructField("_kept", T.StringType()), T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType())])
    cut = dealt.groupBy("_batch").cogroup(answers.repartition(parts, "batch").groupBy("batch")).applyInArrow(_cut(width, seed, buckets, heavy), kinds)
    place = {c: F.col(f"_rest.c{i}") for i, c in enumerate(rest)} | {text_col: F.col("_kept")}
    return cut.select(*[place[c].alias(c) for c in columns], F.col("_words").alias(n_words), F.col("_removed").alias(n_removed))
