"""Best-fit packing of tokenised documents by a plan over the histogram of their lengths.

Best fit puts a piece into the open sequence with the least room that holds it, longest pieces first. Pieces of
one length are alike and so are sequences with the same content, so the plan is made on counts: its size depends
on the sequence length and not on the number of documents. Each line of the plan gives pieces of one length,
by their rank in that length, a sequence and an offset; documents take these slots by joining on length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import bound_arrow, materialise
from .textkit import slices, texts_of
from .token_counts import counter, ragged
from .vocabulary import read

_SLOTS_AT_ONCE, _RANK_GROUP = 100_000, 1000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Lines (length, first rank, count, pieces a sequence, first sequence, offset of the first piece).

    A line's piece of rank ``first + i`` goes to sequence ``first sequence + i // pieces``, at
    ``offset + (i % pieces) * length``."""
    # a group: room left, sequences alike, and its content as (group before, length, pieces a sequence)
    groups: list[list] = []
    by_room: dict[int, list[int]] = {}

    def add(room: int, count: int, content) -> None:
        groups.append([room, count, content])
        if room:
            by_room.setdefault(room, []).append(len(groups) - 1)

    def least(length: int) -> int | None:
        found = [r for r in by_room if r >= length and by_room[r]]
        return min(found, default=None)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = least(length)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * length, full, (None, length, each))
                if rest:
                    add(capacity - rest * length, 1, (None, length, rest))
                left = 0
                continue
            at = by_room[room].pop()
            _, count, content = groups[at]
            groups[at][1] = 0
            each = room // length
            full = min(count, left // each)
            rest = min(left - full * each, each - 1) if full < count else 0
            if full:
                add(room - each * length, full, (content, length, each))
            if rest:
                add(room - rest * length, 1, (content, length, rest))
            over = count - full - bool(rest)
            if over:
                add(room, over, content)
            left -= full * each + rest
    lines, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for _, count, content in groups:
        if not count:
            continue
        parts = []
        while content:
            content, length, each = content
            parts.append((length, each))
        offset = 0
        for length, each in reversed(parts):
            lines.append((length, ranks[length], count * each, each, sequence, offset))
            ranks[length] += count * each
            offset += each * length
        sequence += count
    return lines


def _cut(tokenizer: str, capacity: int, end: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "crc", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(tokenizer)
        for batch in batches:
            for i, j in slices(texts_of(batch.column(1))):
                some = batch.slice(i, j - i)
                ids, first = words.ids([t or "" for t in some.column(1).to_pylist()])
                # each text ends with one more id
                tokens = np.full(len(ids) + len(some), end, "<u4")
                tokens[np.arange(len(ids)) + np.repeat(np.arange(len(some)), np.diff(first))] = ids
                bounds = first + np.arange(len(first))
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                piece = ragged(np.zeros(len(pieces), np.int64), pieces)
                row = np.repeat(np.arange(len(some)), pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = 4 * (bounds[row] + start)
                raw = tokens.tobytes()
                parts = [raw[x : x + 4 * n] for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                crc = pa.array(map(zlib.crc32, parts), pa.int64())
                ids_ = [pa.array(parts, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), crc, *ids_], names)

    return cut


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack texts into sequences of at most ``capacity`` tokens; each ends with the id ``end``.

    Only a text of more than ``capacity`` tokens is cut, into pieces of that many and a rest. Returns for each
    piece ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``, and with ``with_ids`` the ids
    as little-endian unsigned 32-bit integers. The pieces of a sequence stand end to end from offset 0. A null
    or empty text is the end id alone. Ids may be null or repeat: each row is packed for itself. An
    empty table gives an empty one; columns other than the two are not read, whatever their names. A very long text is
    read whole in one task. The vocabulary must drop white space before it splits text into words.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    binary = ", ids binary" * with_ids
    pieces = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(read(tokenizer_path), capacity, end, with_ids), f"id {kind}, piece int, start long, length long, crc long{binary}").withColumn("row", F.monotonically_increasing_id()))
    counts = pieces.groupBy("length").count()
    lines = plan({r["length"]: r["count"] for r in counts.collect()}, capacity)

    # ranks within a length: rows are numbered in salted groups of bounded size, and groups by the rows before them;
    # there are at most ``capacity`` lengths
    salted = pieces.join(F.broadcast(counts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / _RANK_GROUP)).cast("int")).drop("count")
    salts = salted.groupBy("length", "salt").count()
    before = salts.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).alias("before"))
    number = F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("number", number).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("number"))

    table = spark.createDataFrame(lines or [], "length long, first long, n long, each long, sequence long, offset long")
    parts = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_SLOTS_AT_ONCE).cast("long"))).alias("lo")).repartition("length", "lo")
    slots = parts.select("*", F.explode(F.sequence(F.col("lo"), F.least(F.col("n"), F.col("lo") + _SLOTS_AT_ONCE) - 1)).alias("i")).select("length", (F.col("first") + F.col("i")).alias("rank"), (F.col("sequence") + F.expr("i div each")).alias("sequence_id"), (F.col("offset") + F.col("i") % F.col("each") * F.col("length")).alias("offset"))
    out = ranked.join(slots, ["length", "rank"])
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *["ids"] * with_ids)
