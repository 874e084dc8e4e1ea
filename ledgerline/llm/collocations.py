"""Phrases whose words stand together more often than their parts would by chance, by language.

Phrases are counted level by level, one, two and three words, each level in one pass over the texts. A phrase counts
towards a level only if both phrases of one word less that it holds can be frequent themselves (the Apriori rule). That is asked
of a bit map of fixed size with a bit for each frequent phrase of the level below: where the map is crowded more
phrases pass and are counted for nothing, but none is lost.

A phrase is named by 96 bits of two independent hashes of its language and words. A mapper adds up some million phrases at a
time and sends them on in blocks, a block for each range of names, sorted and compressed; the number of ranges
follows from the bytes of the texts, so that a range fits into a task whatever the size of the corpus, and a phrase that is
everywhere comes once a block. For a range, counters of name buckets first tell which names can reach the limit. A minimal perfect hash
over these gives slots, with the names in the slots; each mapper's block becomes an array of counts by slot, and the arrays are
summed in a tree.

A last pass writes down the words of frequent phrases, again in blocks by range; there the names of their parts are made, and the
counts of both parts of each cut are found by name. Parts that are a good share of all words are broadcast, at most 10,000 rows, so that no
join has a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash
from .storage import bound_arrow, discard, materialise
from .textkit import LOWER, Texts, mix, part, slices, texts_of, word_hashes, words_of
from .token_counts import Known, ragged

#: Phrases that a mapper adds up at once, bytes of text for each range of names, bits of a bit map, and of its rows.
_AT_ONCE, _RANGE, _MAP, _ROW = 1_500_000, 16 << 20, 26, 19
#: Counters of name buckets in a range (bits), and the share of all words from which a part is broadcast.
_BUCKETS, _HEAVY = 21, 5000
_SIZES = (1, 2, 3)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
_rng = np.random.Generator(np.random.PCG64(13))
#: For both hashes: an odd factor for each place in a phrase, and a term for each size.
_FACTOR = _rng.integers(0, 2**63, (2, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(0, 2**63, (2, 4), dtype=np.uint64)
_SALT = 77
_CODEC = pa.Codec("zstd", 1)


class _Words(NamedTuple):
    """The words of some texts: their bytes, two hashes of each, its language's two hashes, and whether the next
    word goes on in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    lang: np.ndarray
    lang_a: np.ndarray
    lang_b: np.ndarray
    goes_on: np.ndarray

    def names(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the phrases of ``size`` words from the words ``at`` on."""
        out = []
        for k, (own, lang) in enumerate(((self.a, self.lang_a), (self.b, self.lang_b))):
            h = lang[at] + _TERM[k, size]
            for i in range(size):
                h = h + own[at + i] * _FACTOR[k, i]
            out.append(mix(h))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)

    def places(self, size: int) -> np.ndarray:
        """The words that begin a phrase of ``size`` words within a piece."""
        on = np.ones(len(self.a), bool)
        for i in range(size - 1):
            on[: len(on) - i] &= self.goes_on[i:]
            on[len(on) - i :] = False
        return np.flatnonzero(on)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    """The words of each slice of texts, and the languages of the batch."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        langs = coded.dictionary.to_pylist()
        digests = [blake2b(x.encode(), digest_size=16).digest() for x in langs]
        hashes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        code, texts = coded.indices.to_numpy(), texts_of(batch.column(1))
        for i, j in slices(texts, 1 << 20):
            data, offsets = part(texts, i, j)
            low = Texts(LOWER[data], offsets)
            words = words_of(low, _BETWEEN)
            lang = np.repeat(code[i:j], np.diff(words.bounds))
            piece = np.cumsum(_BREAK[data], dtype=np.int32)[words.starts]
            text = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(words.bounds))
            goes_on = np.append((piece[1:] == piece[:-1]) & (text[1:] == text[:-1]), False) if len(piece) else np.zeros(0, bool)
            yield _Words(low.data, words.starts, words.ends, word_hashes(low.data, words), word_hashes(low.data, words, _SALT), lang, hashes[lang, 0], hashes[lang, 1], goes_on), langs


def _on(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether the bit map has the bits of names."""
    at = a & np.uint64((1 << _MAP) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _squeezed(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _block(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    steps = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return _squeezed(_planes(steps) + b.astype("<u4").tobytes() + _planes(n.astype("<u4")))


def _unblock(block: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(block, 16 * m, asbytes=True), np.uint8)
    whole = lambda x, size, kind: np.ascontiguousarray(x.reshape(size, m).T).view(kind).ravel()
    return np.cumsum(whole(raw[: 8 * m], 8, "<u8"), dtype=np.uint64), raw[8 * m : 12 * m].view("<u4"), whole(raw[12 * m :], 4, "<u4")


def _sum_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different names by ``a``, where each first stands, and how often. One name may come twice if two share ``a``."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], order[new], np.diff(np.append(new, len(a)))


def _mapped(size: int, ranges: int, bits):
    """Blocks of phrases of ``size`` words whose parts ``bits`` let pass; for single words also the number of words by language."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, total = [], 0, {}
        known = np.frombuffer(bits.value, np.uint8) if bits else None

        def sent() -> pa.RecordBatch:
            a, b, _, n = _sum_up(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            own = ((a >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            parts = list(zip(edges.tolist(), [*edges[1:].tolist(), len(a)], strict=True))
            blocks = [_block(a[i:j], b[i:j], n[i:j]) for i, j in parts]
            return pa.RecordBatch.from_arrays([pa.array(own[edges].astype(np.int32)), pa.nulls(len(parts), pa.string()), pa.array([j - i for i, j in parts], pa.int64()), pa.array(blocks, pa.binary())], ["range", "lang", "n", "block"])

        for words, langs in _words(batches):
            at = words.places(size)
            if size == 1:
                for i, n in enumerate(np.bincount(words.lang, minlength=len(langs)).tolist()):
                    total[langs[i]] = total.get(langs[i], 0) + n
            else:
                pass_ = _on(known, words.names(words.places(size - 1), size - 1)[0])
                place = np.zeros(len(words.a) + 1, bool)
                place[words.places(size - 1)] = pass_
                at = at[place[at] & place[at + 1]]
            held.append(words.names(at, size))
            count += len(at)
            if count >= _AT_ONCE:
                yield sent()
                held, count = [], 0
        if count:
            yield sent()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([hash_ % ranges for hash_ in range(len(total))], pa.int32()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.nulls(len(total), pa.binary())], ["range", "lang", "n", "block"])

    return mapped


def tree_sum(arrays: Iterable[np.ndarray], size: int) -> np.ndarray:
    """The sum of arrays, added in pairs, so that few are held at a time."""
    levels: list[np.ndarray | None] = []
    for x in arrays:
        for i, held in enumerate(levels):
            if held is None:
                levels[i] = x
                break
            x, levels[i] = x + held, None
        else:
            levels.append(x)
    return sum((x for x in levels if x is not None), np.zeros(size, np.int64))


def count_by_slot(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (a, b) that come ``least`` times or more in blocks of names and counts, and their counts."""
    low = np.uint64((1 << _BUCKETS) - 1)
    buckets = np.zeros(1 << _BUCKETS)
    for a, _, n in blocks:
        buckets += np.bincount((a & low).astype(np.int64), n, 1 << _BUCKETS)
    can = [buckets[(a & low).astype(np.int64)] >= least for a, _, _ in blocks]
    a, b = (np.concatenate([x[k][c] for x, c in zip(blocks, can, strict=True)]) for k in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    table = PerfectHash(a[new], b[new])

    def counted() -> Iterator[np.ndarray]:
        for x, y, n in blocks:
            slot = table.slots(x, y)
            yield np.bincount(slot[slot >= 0], n[slot >= 0], table.n).astype(np.int64)

    counts = tree_sum(counted(), table.n)
    keep = counts >= least
    return table.a[keep], table.b[keep], counts[keep]


def _reduced(size: int, least: int):
    def reduced(table: pa.Table) -> pa.Table:
        langs: dict[str, int] = {}
        blocks = []
        for lang, n, block in zip(*(table.column(c).to_pylist() for c in ("lang", "n", "block")), strict=True):
            if block is None:
                langs[lang] = langs.get(lang, 0) + n
            else:
                blocks.append(_unblock(block, n))
        a, b, f = count_by_slot(blocks, least) if blocks else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        m = len(langs)
        return pa.table({
            "size": pa.array([size] * len(a) + [None] * m, pa.int32()),
            "a": pa.concat_arrays([pa.array(a.view(np.int64)), pa.nulls(m, pa.int64())]),
            "b": pa.concat_arrays([pa.array(b.astype(np.int64)), pa.nulls(m, pa.int64())]),
            "f": pa.concat_arrays([pa.array(f), pa.array(list(langs.values()), pa.int64())]),
            "lang": pa.array([None] * len(a) + list(langs), pa.string()),
        })

    return reduced


def _bit_map(names: DataFrame) -> bytes:
    """A bit for each name, by its low bits: 8 MB whatever their number."""
    rows = 1 << (_MAP - _ROW)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((rows, (1 << _ROW) // 8), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << _MAP) - 1)
            np.bitwise_or.at(bits.reshape(-1), at >> 3, (1 << (at & 7)).astype(np.uint8))
        own = np.flatnonzero(bits.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([bits[i].tobytes() for i in own], pa.binary())], ["row", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"row": pa.array([table.column("row")[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    found = names.select("a").coalesce(32).mapInArrow(marked, "row int, bits binary").groupBy("row").applyInArrow(joined, "row int, bits binary").collect()
    out = bytearray((1 << _MAP) // 8)
    for r in found:
        out[r["row"] << (_ROW - 3) : (r["row"] + 1) << (_ROW - 3)] = r["bits"]
    return bytes(out)


def _joined(words: _Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of phrases, words apart by one blank and each phrase ended by a line end, and their lengths."""
    place = at[:, None] + np.arange(size)
    starts, n = words.starts[place].ravel(), (words.ends[place] - words.starts[place]).ravel()
    to = np.cumsum(n + 1) - n - 1
    out = np.full(int((n + 1).sum()), 0x20, np.uint8)
    out[ragged(to, n)] = words.data[ragged(starts, n)]
    whole = (n + 1).reshape(-1, size).sum(axis=1)
    out[np.cumsum(whole) - 1] = 0x0A
    return out, whole


def _written(bits, ranges: int):
    """Blocks of the words of phrases whose names ``bits`` lets pass, by range of names and language; a task gives a phrase about once."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        seen, numbers, held, count = Known(1 << 19), {}, [], 0

        def sent() -> pa.RecordBatch:
            own, lang, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((lang, own))
            starts = np.cumsum(sizes) - sizes
            data, own, lang = data[ragged(starts[order], sizes[order])], own[order], lang[order]
            ends = np.cumsum(sizes[order])
            edges = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (lang[1:] != lang[:-1])]))
            stops = [*(ends[edges[1:] - 1]).tolist(), len(data)]
            blocks = [_squeezed(data[i:j].tobytes()) for i, j in zip([0, *stops[:-1]], stops, strict=True)]
            names = list(numbers)
            lengths = np.diff([0, *stops])
            return pa.RecordBatch.from_arrays([pa.array(own[edges].astype(np.int32)), pa.array([names[i] for i in lang[edges].tolist()], pa.string()), pa.array(lengths.astype(np.int64)), pa.array(blocks, pa.binary())], ["range", "lang", "n", "block"])

        for words, langs in _words(batches):
            code = np.array([numbers.setdefault(x, len(numbers)) for x in langs], np.int64)
            for size in _SIZES[1:]:
                at = words.places(size)
                a, b = words.names(at, size)
                on = np.flatnonzero(_on(known, a))
                key = np.stack([a[on], b[on].astype(np.uint64)], axis=1)
                found, new = seen.find(key)
                seen.again[found] = True
                seen.again[seen.n - len(new) : seen.n] = False
                at = at[on[new]]
                data, sizes = _joined(words, at, size)
                held.append((((key[new, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), code[words.lang[at]], sizes, data))
                count += len(data)
            if count >= _RANGE // 2:
                yield sent()
                held, count = [], 0
        if count:
            yield sent()

    return written


def _named(table: pa.Table) -> pa.Table:
    """The different phrases of a range with their names, and the names of the two parts of each cut."""
    texts: dict[str, set[bytes]] = {}
    for lang, n, block in zip(*(table.column(c).to_pylist() for c in ("lang", "n", "block")), strict=True):
        texts.setdefault(lang, set()).update(_CODEC.decompress(block, n, asbytes=True)[:-1].split(b"\n"))
    rows = [(lang, t) for lang, own in texts.items() for t in own]
    source = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary()).cast(pa.string())], ["lang", "text"])
    out = []
    for words, langs in _words(iter([source])):
        begins = np.flatnonzero(np.concatenate([[True], ~words.goes_on[:-1]]))
        lengths = np.diff(np.append(begins, len(words.a)))
        for size in _SIZES[1:]:
            at = begins[lengths == size]
            a, b = words.names(at, size)
            pairs = [words.names(at + skip, k) for cut in range(1, size) for skip, k in ((0, cut), (cut, size - cut))]
            flat = [np.stack([x.astype(np.int64) for x in side], axis=1).reshape(-1) for side in zip(*pairs, strict=True)]
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(pairs)), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["a", "b"]))
            text, starts, ends = words.data.tobytes(), words.starts[at].tolist(), words.ends[at + size - 1].tolist()
            phrases = [text[s:e].decode() for s, e in zip(starts, ends, strict=True)]
            out.append(pa.table([pa.array([langs[i] for i in words.lang[at].tolist()], pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(at), size, np.int32)), pa.array(a.view(np.int64)), pa.array(b.astype(np.int64)), parts], ["lang", "phrase", "size", "a", "b", "parts"]))
    return pa.concat_tables(out)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, inside_percent: int = 50) -> DataFrame:
    """The ``top`` phrases of two and three words of each language by the score of their weakest cut.

    Texts are lower-cased in A-Z and split at ``. , ; : ! ?`` and 0x0A-0x0D into pieces, and these at blanks and tabs into words.
    ``a`` is how often a phrase stands in pieces, overlaps included, ``least`` or more; of a cut ``l`` and ``r`` are the same of
    its two parts, and its score is floor(1000000 * a * a / (l * r)), exactly. The cut of least score counts, and of equal
    ones the first. A phrase of two words is left out if ``inside_percent`` of its places or more are inside one phrase of three that
    comes ``least`` times. Returns ``lang``, ``rank`` (from 1, by score and a descending, then phrase), ``phrase``,
    ``a``, ``l``, ``r``, ``n`` (all words of the language) and ``score``.

    A null language is ``und``; a null, empty or blank text has no words. Ids are not read, and rows that repeat count as often as
    they stand there. An empty table gives an empty one; other columns are not read, whatever their names. A long text is
    read whole in one task. Numbers are exact up to counts of 10^15."""
    spark = docs.sparkSession
    bound_arrow(spark)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = -(-size // _RANGE) or 1
    levels, bits = [], None
    for k in _SIZES:
        blocks = source.mapInArrow(_mapped(k, ranges, bits), "range int, lang string, n long, block binary")
        levels.append(materialise(blocks.groupBy("range").applyInArrow(_reduced(k, least), "size int, a long, b long, f long, lang string")))
        if bits:
            bits.unpersist()
        if k < _SIZES[-1]:
            bits = spark.sparkContext.broadcast(_bit_map(levels[-1].where("a IS NOT NULL")))
    words = levels[0].where("a IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    singles, pairs, triples = (x.where("a IS NOT NULL").drop("lang") for x in levels)
    bits = spark.sparkContext.broadcast(_bit_map(pairs.unionByName(triples)))
    blocks = source.mapInArrow(_written(bits, ranges), "range int, lang string, n long, block binary")
    texts = blocks.groupBy("range").applyInArrow(_named, "lang string, phrase string, size int, a long, b long, parts array<struct<a: long, b: long>>")
    phrases = materialise(texts.join(pairs.unionByName(triples).select("a", "b", "f"), ["a", "b"]))
    bits.unpersist()

    # counts of the parts, by name
    counts = singles.unionByName(pairs).select("a", "b", F.col("f").alias("part_f"))
    total = words.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("part_f") * _HEAVY >= F.lit(total))
    parts = phrases.select(F.col("a").alias("own_a"), F.col("b").alias("own_b"), F.posexplode("parts").alias("at", "part")).select("own_a", "own_b", "at", "part.a", "part.b")
    tried = parts.join(F.broadcast(heavy), ["a", "b"], "left")
    hot = tried.where("part_f IS NOT NULL")
    cold = tried.where("part_f IS NULL").drop("part_f").join(counts.where(F.col("part_f") * _HEAVY < F.lit(total)), ["a", "b"])
    found = hot.unionByName(cold).groupBy(F.col("own_a").alias("a"), F.col("own_b").alias("b")).agg(*[F.max(F.when(F.col("at") == i, F.col("part_f"))).alias(f"p{i}") for i in range(4)])

    # a pair inside a triple: its parts at the places 1 and 2 are the pairs that it holds
    inside = phrases.where("size = 3").select(F.explode(F.array(F.get("parts", F.lit(1)), F.get("parts", F.lit(2)))).alias("pair"), "f").groupBy(F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).agg(F.max("f").alias("longest"))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    score = lambda left, right: F.call_function("div", whole("f") * whole("f") * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right))
    scored = phrases.drop("parts").join(found, ["a", "b"]).withColumn("s1", score("p0", "p1")).withColumn("s2", F.when(F.col("size") == 3, score("p2", "p3")))
    first = F.col("s2").isNull() | (F.col("s1") <= F.col("s2"))
    kept = scored.join(inside, ["a", "b"], "left").where(F.coalesce(100 * F.col("longest") < inside_percent * F.col("f"), F.lit(True)))
    chosen = kept.select("lang", "phrase", F.col("f").alias("a"), F.when(first, F.col("p0")).otherwise(F.col("p2")).alias("l"), F.when(first, F.col("p1")).otherwise(F.col("p3")).alias("r"), F.when(first, F.col("s1")).otherwise(F.col("s2")).cast("long").alias("score"))
    ranked = chosen.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    out = materialise(ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    discard(*levels, phrases)
    return out
