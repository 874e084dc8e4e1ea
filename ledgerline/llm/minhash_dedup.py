"""Near-duplicate groups of texts: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash walks, for each shingle, a random permutation of the registers: its j-th step offers
``j + uniform`` to one register, and each register keeps the least offer. Round j only offers values of
at least j, so once a text's registers are all filled, no later round can change them: long texts stop after
a round or two. Here all shingles of a slice of texts take a round together.

With the defaults (28 bands of 4 registers) a pair at similarity 0.75 shares no band with probability 2e-5.
Texts with equal shingle sets are one class, a node of the graph with a number of its own, and only classes are
banded. A group of n near copies must not cost
n squared pairs, and yet no link may be lost that decides a component:

1. Each member of a band's bucket is compared with one pivot of the bucket, which joins most of a group.
2. Buckets that are still in several components compare members of different components only. Small ones
   (up to 8 members) do so as pairs; larger ones in tiles of bounded size, the members outside the bucket's
   main component against all. A tile pair works on signatures in memory, looks at each pair in the first band that
   it shares, confirms on full sets what the signatures leave possible, and returns at most one link for
   each component that it joins.

The pairs of a pivot are dealt to salts by the size of their bucket and its text goes to each, so a large group is
confirmed by many tasks. What else meets by the key of a bucket or class are rows of a few numbers, in joins that
nothing follows which needs their partitioning: there adaptive execution splits a key with very many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import bound_arrow, discard, free_name, materialise
from .textkit import mix, part, shingle_sets, slices, texts_of

_EMPTY = np.uint64(2**64 - 1)
_GOLDEN = 0x9E3779B97F4A7C15


def signatures(hashes: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """One row of m registers for each set ``hashes[bounds[i]:bounds[i + 1]]``; all ``_EMPTY`` for an empty one.

    A register holds the round in its top 16 bits and the uniform fraction below."""
    sizes = np.diff(bounds)
    out = np.full(len(sizes) * m, _EMPTY)
    owner, x, walk = np.repeat(np.arange(len(sizes)), sizes), hashes, None
    for j in range(m):
        if not len(x):
            break
        offer = mix(x + np.uint64((j + 1) * _GOLDEN % 2**64))
        to = j + (((offer & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(x))
        register = to if walk is None else walk[rows, to]
        np.minimum.at(out, owner * m + register, (offer >> np.uint64(16)) | np.uint64(j << 48))
        open_sets = (out.reshape(-1, m) == _EMPTY).any(axis=1)
        stay = open_sets[owner]
        if walk is None:
            x, owner, to = x[stay], owner[stay], to[stay]
            walk = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            walk[np.arange(len(x)), to] = 0
        else:
            walk[rows, to] = walk[:, j]
            if stay.mean() < 0.7:
                x, owner, walk = x[stay], owner[stay], walk[stay]
    return out.reshape(-1, m)


def _profile(bands: int, rows: int) -> Callable:
    names = ["id", "h", "n", "k1", "k2", "bands"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for i, j in slices(texts):
                h, bounds = shingle_sets(part(texts, i, j))
                sizes = np.diff(bounds)
                registers = signatures(h, bounds, bands * rows).reshape(-1, bands, rows)
                keys = np.zeros(registers.shape[:2], np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(_GOLDEN) + registers[:, :, r])
                keys = mix(keys + np.arange(bands, dtype=np.uint64))
                some = sizes > 0
                names_ = np.zeros((2, len(sizes)), np.uint64)
                if len(h):
                    for k in (0, 1):
                        names_[k, some] = np.add.reduceat(mix(h ^ np.uint64((k + 7) * _GOLDEN % 2**64)), bounds[:-1][some])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sizes), pa.array(names_[0].view(np.int64)), pa.array(names_[1].view(np.int64)), lists], names)

    return profile


def _confirm(percent: int) -> Callable:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            left, right = texts_of(batch.column(2)), texts_of(batch.column(3))
            _, first, which = np.unique(b, return_index=True, return_inverse=True)
            pivots = []
            for f in first:
                pivots.append(shingle_sets(part(right, int(f), int(f) + 1))[0])
            linked = np.zeros(len(a), bool)
            for i, j in slices(left):
                h, bounds = shingle_sets(part(left, i, j))
                for k in range(i, j):
                    own, other = h[bounds[k - i] : bounds[k - i + 1]], pivots[which[k]]
                    both = np.sort(np.concatenate([own, other]))
                    shared = int((both[1:] == both[:-1]).sum())
                    linked[k] = shared > 0 and 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    return confirm


def _signed(bands: int, rows: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in slices(texts):
                h, bounds = shingle_sets(part(texts, i, j))
                registers = signatures(h, bounds, bands * rows)
                sets = [h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in registers], pa.binary()), pa.array(sets, pa.binary())], ["node", "signature", "elements"])

    return signed


class _Tile:
    def __init__(self, rows: pa.StructArray, width: int):
        ids, group, signatures_, elements = (rows.field(i) for i in range(4))
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.group = group.to_numpy(zero_copy_only=False)
        self.signature = np.frombuffer(b"".join(signatures_.to_pylist()), np.uint64).reshape(len(self.ids), width)
        self.sets = [np.frombuffer(x, np.uint64) for x in elements.to_pylist()]
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))


def tile_links(a: _Tile, b: _Tile, own: bool, band: int, rows: int, percent: int, least: float = 0.5) -> list[tuple[int, int]]:
    """Links between different components across two tiles, at most one for each two components that they join.

    ``least`` is the share of equal registers below which a pair is not confirmed: for a pair at similarity 0.75
    it is six standard deviations away. A pair that agrees in a band before ``band`` is left to that band's bucket:
    whole registers are compared, so that such a pair has one band key there."""
    parent = {g: g for g in {*a.group.tolist(), *b.group.tolist()}}

    def root(g: int) -> int:
        while parent[g] != g:
            g = parent[g]
        return g

    out = []
    for x in range(len(a.ids)):
        same = b.signature == a.signature[x]
        likely = (same.sum(axis=1) >= least * same.shape[1]) & (100 * np.minimum(b.sizes, a.sizes[x]) >= percent * np.maximum(b.sizes, a.sizes[x])) & (b.group != a.group[x])
        if own:
            likely[: x + 1] = False
        at = np.flatnonzero(likely)
        if band and len(at):
            at = at[~same[at, : band * rows].reshape(len(at), band, rows).all(axis=2).any(axis=1)]
        mine = root(int(a.group[x]))
        at = [y for y in at.tolist() if root(int(b.group[y])) != mine]
        if not at:
            continue
        sizes = b.sizes[at]
        flat = np.concatenate([b.sets[y] for y in at])
        place = np.minimum(np.searchsorted(a.sets[x], flat), len(a.sets[x]) - 1)
        shared = np.add.reduceat((a.sets[x][place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        for y, k, n in zip(at, shared.tolist(), sizes.tolist(), strict=True):
            mine, other = root(int(a.group[x])), root(int(b.group[y]))
            if mine != other and 100 * k >= percent * (len(a.sets[x]) + n - k):
                parent[max(mine, other)] = min(mine, other)
                out.append((int(a.ids[x]), int(b.ids[y])))
    return out


def _compare(rows: int, bands: int, percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, own, first, second in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                a = _Tile(first.values, bands * rows)
                found = tile_links(a, a if own else _Tile(second.values, bands * rows), own, band, rows, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return compare


_SMALL, _TILE = 8, 120_000
#: Pairs of one pivot and salt, about.
SALTED = 1000


def _salt(node: str, size: str) -> Column:
    return F.pmod(F.xxhash64(node), F.ceil(F.col(size) / SALTED)).cast("int")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = 28, rows: int = 4) -> DataFrame:
    """One row (id, h, n, component, first) for each row of ``docs``, ``h`` being ``xxhash64`` of its text: see
    :func:`near_duplicates`. ``first`` marks the rows whose id and, where ids are equal, ``h`` are the least of a component."""
    spark = docs.sparkSession
    bound_arrow(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    profiles = materialise(source.mapInArrow(_profile(bands, rows), "id long, h long, n long, k1 long, k2 long, bands array<long>"))
    named = profiles.where("n > 0 AND id IS NOT NULL")
    grouped = named.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "h")).alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    stored = materialise(grouped)
    # a class is the node of its least id, unless ids repeat: then several classes may share one
    repeated = not named.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        before, stored = stored, materialise(stored.withColumn("node", F.monotonically_increasing_id()))
        discard(before)
    classes = stored if repeated else stored.withColumn("node", F.col("rep.id"))
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot"), F.min_by("n", "node").alias("pivot_n")).where("size > 1")
    members = materialise(banded.join(buckets, "key"))
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    texts = source.join(wanted, ["id", "h"])
    texts = materialise((texts.dropDuplicates(["id", "h"]) if repeated else texts).select("node", "text"))

    def verified(pairs: DataFrame, salted: bool) -> DataFrame:
        """Pairs (node, n, pivot, pivot_n, size) that link. Where ``salted``, a pivot's pairs are dealt to salts by the size of
        their bucket, and its text goes to each."""
        sized = pairs.where(100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n"))
        asked = sized.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("size").alias("size"))
        own = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        other = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        keys = ["b"]
        if salted:
            asked, keys = asked.select("a", "b", _salt("a", "size").alias("salt")), ["b", "salt"]
            other = asked.select("b", "salt").distinct().join(other, "b")
        return asked.join(own, "a").join(other, keys).select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long")

    links = materialise(verified(members.where("node != pivot").select("node", "n", "pivot", "pivot_n", "size"), True))
    groups = components(links, "a", "b")

    # the members of buckets that are in several components; one pivot has settled a bucket of two
    labelled = members.where("size > 2").select("key", "band", "node", "n", "size").join(groups.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    counts = labelled.groupBy("key", "c").agg(F.count("*").alias("count"), F.sum("n").alias("sum"))
    shares = counts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "c", "sum")).alias("main"), F.sum("sum").alias("sum")).where("parts > 1")
    shares = shares.select("key", F.col("main.c").alias("main"), F.col("main.sum").alias("main_sum"), (F.col("sum") - F.col("main.sum")).alias("minor_sum"))
    split = materialise(labelled.join(shares, "key"))
    small = split.where(F.col("size") <= _SMALL).select("key", "node", "n", "c", "size")
    other = small.select("key", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("c").alias("pivot_c"))
    pairs = small.join(other, "key").where((F.col("node") > F.col("pivot")) & (F.col("c") != F.col("pivot_c")))
    more = materialise(verified(pairs, False))

    minor = F.col("c") != F.col("main")
    tiles_of = F.ceil(F.when(minor, F.col("minor_sum")).otherwise(F.col("main_sum")) / _TILE)
    dealt = split.where(F.col("size") > _SMALL).select("key", "band", minor.alias("minor"), F.pmod(F.xxhash64("node"), tiles_of).cast("int").alias("sub"), "node", "c")
    signed = texts.join(dealt.select("node").distinct(), "node", "left_semi").mapInArrow(_signed(bands, rows), "node long, signature binary, elements binary")
    tiles = materialise(dealt.join(signed, "node").groupBy("key", "band", "minor", "sub").agg(F.collect_list(F.struct("node", "c", "signature", "elements")).alias("rows")))
    keys = tiles.select("key", "minor", "sub")
    met = keys.where("minor").select("key", F.col("sub").alias("sub_a")).join(keys, "key").where("NOT minor OR sub >= sub_a")
    first = tiles.where("minor").select("key", F.col("sub").alias("sub_a"), F.col("rows").alias("a"))
    blocks = met.join(first, ["key", "sub_a"]).join(tiles.withColumnRenamed("rows", "b"), ["key", "minor", "sub"])
    tiled = materialise(blocks.select("band", (F.col("minor") & (F.col("sub") == F.col("sub_a"))).alias("own"), "a", "b").mapInArrow(_compare(rows, bands, percent), "a long, b long"))

    joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    every = components(joined.unionByName(more).unionByName(tiled), "a", "b")
    discard(members, texts, links, groups, split, more, tiles, tiled)
    found = classes.select("node", "k1", "k2", "n", "rep", "size").join(every, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if repeated:  # the least (id, h) of each component
        found = found.join(found.groupBy("component").agg(F.min("rep").alias("least")), "component").withColumn("component", F.col("least.id")).withColumn("rep", F.col("least"))
    found = found.select("k1", "k2", "n", "component", F.col("rep.id").alias("first_id"), F.col("rep.h").alias("first_h"))
    out = profiles.select("id", "h", "n", "k1", "k2").join(found, ["k1", "k2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    first = (F.col("id") == F.col("component")) & (F.col("id") == F.col("first_id")) & (F.col("h") == F.col("first_h"))
    return out.select("id", "h", "n", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), (alone | first).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = 28, rows: int = 4) -> DataFrame:
    """Group texts whose sets of lower-cased five-word shingles have ``100 * intersection >= percent * union``.

    Returns one row for each input row: ``id_col`` as a long, ``n_shingles``, ``component_id`` (the least id
    reachable by links, itself included) and ``kept`` (its id is that). A text of fewer than five words has
    its word sequence as its one shingle. A null, empty or blank text has no shingles and links with nothing.
    A null id gives a null component and stays kept. Rows that share an id are judged each by its own text;
    rows that repeat id and text are judged alike. An empty table gives an empty one. Columns other than the two
    are not read, whatever their names; an id that is not a number fails on the cast to long.
    """
    out = judged(docs, id_col, text_col, percent, bands, rows)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` whose text is the least-numbered of its near-duplicate group, with all columns.

    Each row is judged by its own text. Where near-duplicate texts share the least id, the one with the least
    ``xxhash64`` stays. Rows without an id stay. Rows that repeat id and text are judged alike; unless ``repeats``, one of them stays. An empty table gives
    an empty one, and columns keep their names.
    """
    rows = judged(docs, id_col, text_col)
    gone = rows.where("NOT first").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_hash")).distinct()
    ident, text = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    kept = docs.join(gone, (ident == gone["gone_id"]) & (text == gone["gone_hash"]), "left_anti")
    if repeats or rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        return kept
    own, hashed = free_name(docs, "_id"), free_name(docs, "_hash")
    return kept.withColumns({own: ident, hashed: text}).dropDuplicates([own, hashed]).drop(own, hashed)
