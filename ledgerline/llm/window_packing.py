"""Packing in order: windows over the stream of tokens, cut where padding and truncation together cost least.

The documents of a partition stand end to end in their order, and each window of this stream is a sequence. Where a
document ends a cut is free; at the end of a sentence and inside one it costs a penalty. The least cost up to a
place is its penalty plus the least over the cuts that one window can reach back to, of their cost and the padding. As padding
falls by one for each token further, the best of these is kept by a monotone queue, in constant time a place. A
sequence whose length is a power of two is not padded; such cuts are looked up one by one.

A task holds a stretch of some hundred thousand tokens. Its last window stays open and begins the next stretch, so that only
the end of a partition can cost padding for the lack of more text. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_arrow
from .textkit import slices, texts_of
from .token_counts import counter
from .vocabulary import Vocabulary, read, vocabulary

#: Tokens that are planned together, bits of a sequence's number in its partition, and tokens between places inside a sentence.
_STRETCH, _PART, _STRIDE = 1 << 19, 40, 32
#: A cost holds padding and penalties above these bits, and below them the number of sequences, which settles ties.
_COUNT = 24


def least_cuts(places: np.ndarray, penalty: np.ndarray, capacity: int, whole: bool) -> tuple[list[int], int]:
    """Cuts of a stream at some of ``places``, which ascend from 0, at most ``capacity`` apart: indices of the ends of the
    windows, and their cost.

    The cost is padding to ``capacity``, none where a window's length is a power of two, and the penalty of each cut; of
    equal costs the one with fewer windows. If ``whole``, the last place is the last cut; else the last cut is the one of least
    cost from which one window reaches the last place."""
    last = len(places) - 1
    froms, ends = [], []
    power = 1
    while power < capacity:
        at = np.searchsorted(places, places - power)
        hit = np.flatnonzero(places[at] == places - power)
        froms.append(at[hit])
        ends.append(hit)
        power *= 2
    end = np.concatenate([*ends, [last + 1]])
    order = np.argsort(end, kind="stable")
    special, due = np.concatenate([*froms, [0]])[order].tolist(), end[order].tolist()
    place, step = places.tolist(), ((penalty.astype(np.int64) << _COUNT) + 1).tolist()
    cost, back, key = [0], [-1], [0]
    queue, head, s = [0], 0, 0
    for j in range(1, last + 1):
        here = place[j]
        low = here - capacity
        while place[queue[head]] < low:
            head += 1
        i = queue[head]
        best = key[i] - (low << _COUNT)
        while due[s] == j:
            k = special[s]
            s += 1
            if cost[k] < best:
                best, i = cost[k], k
        best += step[j]
        cost.append(best)
        back.append(i)
        best += here << _COUNT
        key.append(best)
        while len(queue) > head and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    stop = last
    if not whole:
        first = int(np.searchsorted(places, places[-1] - capacity))
        stop = min(range(max(first, 1), last + 1), key=lambda j: (cost[j], -j))
    total, out = cost[stop] >> _COUNT, []
    while stop > 0:
        out.append(stop)
        stop = back[stop]
    return out[::-1], total


class Sentences:
    """Where sentences end in token ids, by what tokens end and begin with."""

    def __init__(self, vocab: Vocabulary):
        bytes_of = vocab.bytes_of
        bare = [t.rstrip(b"\"')]}") for t in bytes_of]
        self.stops = np.array([t.endswith((b".", b"!", b"?")) for t in bare])
        self.breaks = np.array([t.endswith((b"\n", "。".encode(), "！".encode(), "？".encode())) for t in bytes_of])
        self.opens = np.array([t[:1].isspace() for t in bytes_of])

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Places in ``ids``, 1 at least, before which a sentence ends."""
        return np.flatnonzero(self.breaks[ids[:-1]] | (self.stops[ids[:-1]] & self.opens[ids[1:]])) + 1


def _cuts(tokens: np.ndarray, ends: np.ndarray, end: int, sentences: Sentences, costs: tuple[int, int], capacity: int, whole: bool) -> np.ndarray:
    """Ends of the windows of a stretch of tokens, whose documents end at ``ends``."""
    last = len(tokens)
    penalty = np.full(last + 1, -1)
    penalty[sentences.after(np.where(tokens == end, 0, tokens))] = costs[0]
    penalty[ends] = penalty[0] = 0
    # long stretches without an end get places of their own
    known = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(np.append(known, last)) > _STRIDE)
    stops = np.append(known, last)
    for i in wide.tolist():
        penalty[known[i] + _STRIDE : stops[i + 1] : _STRIDE] = costs[1]
    places = np.flatnonzero(penalty >= 0)
    cuts, _ = least_cuts(places, penalty[places], capacity, whole)
    return places[cuts]


def _packed(text: str, capacity: int, end: int, costs: tuple[int, int], with_ids: bool):
    names = ["id", "start", "length", "crc", "doc_tokens", "sequence", "offset", *["ids"] * with_ids]
    stride = min(_STRETCH, 1 << (_COUNT - 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sentences = counter(text), Sentences(vocabulary(text))
        sequence = TaskContext.get().partitionId() << _PART
        # what is open: ids of documents, where each begins among their tokens, its tokens in all, and its tokens
        open_ids, open_starts, open_sizes, open_tokens, held = [], [], [], [], 0

        def closed(whole: bool) -> pa.RecordBatch:
            nonlocal sequence, open_ids, open_starts, open_sizes, open_tokens, held
            tokens = np.concatenate(open_tokens)
            ends = np.cumsum([len(t) for t in open_tokens])
            cuts = _cuts(tokens, ends, end, sentences, costs, capacity, whole)
            stop = int(cuts[-1])
            edges = np.unique(np.concatenate([[0], ends[ends < stop], cuts]))
            begin, size = edges[:-1], np.diff(edges)
            doc, window = np.searchsorted(ends, begin, "right"), np.searchsorted(cuts, begin, "right")
            firsts = np.concatenate([[0], ends[:-1]])
            raw = tokens.astype("<u4").tobytes()
            parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
            start = np.array(open_starts)[doc] + begin - firsts[doc]
            offset = begin - np.concatenate([[0], cuts])[window]
            ids = pa.array([open_ids[i] for i in doc.tolist()], kind)
            out = [ids, pa.array(start), pa.array(size), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(np.array(open_sizes)[doc]), pa.array(sequence + window), pa.array(offset)]
            sequence += len(cuts)
            # the document that the last cut goes through, and those after it
            left = int(np.searchsorted(ends, stop, "right"))
            gone = stop - int(firsts[left]) if left < len(ends) else 0
            open_ids, open_starts, open_sizes, open_tokens = open_ids[left:], open_starts[left:], open_sizes[left:], open_tokens[left:]
            if gone:
                open_starts[0] += gone
                open_tokens[0] = open_tokens[0][gone:]
            held = len(tokens) - stop
            return pa.RecordBatch.from_arrays([*out, *[pa.array(parts, pa.binary())] * with_ids], names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for i, j in slices(texts_of(batch.column(1))):
                some = batch.slice(i, j - i)
                ids, first = words.ids([t or "" for t in some.column(1).to_pylist()])
                for k, ident in enumerate(some.column(0).to_pylist()):
                    own = np.append(ids[first[k] : first[k + 1]].astype(np.int64), end)
                    open_ids.append(ident)
                    open_starts.append(0)
                    open_sizes.append(len(own))
                    open_tokens.append(own)
                    held += len(own)
                    if held >= stride:
                        yield closed(False)
        if held:
            yield closed(True)

    return packed


def pack_windows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 1, sentence_penalty: int = 16, inside_penalty: int = 64, with_ids: bool = False) -> DataFrame:
    """Pack texts in the order of their rows into sequences of at most ``capacity`` tokens, each text ending with the id
    ``end``, so that padding and penalties are least.

    A cut between documents is free, one at the end of a sentence costs ``sentence_penalty`` tokens and one inside
    ``inside_penalty``. A sequence is padded to ``capacity`` unless its length is a power of two. Cuts are planned for about half a
    million tokens at once. Returns for each piece of a document ``id_col``, ``start`` (its document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset``, and with ``with_ids`` the ids as
    little-endian unsigned 32-bit integers. The pieces of a sequence stand end to end from offset 0.

    Sequences never reach from one partition into another, so each partition has one last sequence of its own. Its number is
    made from the partition's, and a repeated task gives the same pieces if its rows come in the same order, as they do from files
    and written tables. A null or empty text is the end id alone. Ids may be null or repeat: each row is packed for itself. An
    empty table gives an empty one; columns other than the two are not read, whatever their names. A very long text is tokenised
    whole in one task and cut like any other. The vocabulary must keep white space."""
    if capacity < _STRIDE or min(sentence_penalty, inside_penalty) < 0:
        raise ValueError(f"capacity must be {_STRIDE} or more, and penalties 0 or more")
    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    binary = ", ids binary" * with_ids
    packed = _packed(read(tokenizer_path), capacity, end, (sentence_penalty, inside_penalty), with_ids)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(packed, f"id {kind}, start long, length long, crc long, doc_tokens long, sequence long, offset long{binary}")
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset", *["ids"] * with_ids)
