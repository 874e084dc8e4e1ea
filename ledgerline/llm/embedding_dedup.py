"""Near-duplicate vectors by cosine, compared tile by tile in the order of their principal components.

Unit vectors are turned into the basis of their second-moment matrix, so that the first coordinates hold
most of each product. A tile pair adds up the leading coordinates first; what the rest can add is at most
the product of the two suffix norms, and a pair whose bound is below the threshold is not carried on. Pairs
that reach the end are confirmed on the unit vectors, scaled from the original components, in double precision.

Two unit vectors with cosine t are at distance sqrt(2 - 2t), so their first coordinates are no farther
apart: vectors are dealt to slabs of that width, and a slab only meets itself and the next one. Slabs are cut
by a hash of the id into blocks of bounded size, which travel to where they meet; a task compares two blocks
tile by tile. A tile pair returns one row for each vector that has a link (links, and a root of its component in the
pair), never the pairs themselves. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import bound_arrow, discard, materialise

_KEY = ["label", "dim", "slab", "sub"]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x x' over the unit vectors of a partition, one row for each number of dimensions."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, own, _, _ in _by_dim(batch.column(0)):
            sums[d] = sums.get(d, 0) + own.T @ own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], ["dim", "m"])


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The vectors of a list column by length: length, unit rows, rows as given, row numbers. Zero vectors and
    such as hold a component that is null or not finite are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(at)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)  # null becomes nan
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max(axis=1)
            good = np.isfinite(x).all(axis=1) & (top > 0)
        x, at, top = x[good], at[good], top[good]
        scaled = x / top[:, None]
        yield d, scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None], x, at


def _place(bases: dict[int, np.ndarray], width: float) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, unit, _, at in _by_dim(batch.column(2)):
                rows = pa.array(at)
                slab = np.floor((unit @ bases[d][:, 0] + 1) / width).astype(np.int32)
                raw = pa.array([v.tobytes() for v in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(3).take(rows), pa.array(np.full(len(at), d, np.int32)), pa.array(slab), raw], ["rep", "label", "weight", "dim", "slab", "unit"])

    return place


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, step: int = 8) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit vectors) have a cosine of at least ``threshold``, as a matrix."""
    ra, rb, d = a @ basis, b @ basis, a.shape[1]
    # squared suffix norms: what is left after the first k coordinates
    sa, sb = (np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])) for r in (ra, rb))
    k = min(2 * step, d)
    so_far = ra[:, :k] @ rb[:, :k].T
    bound = so_far + np.outer(sa[:, k], sb[:, k]) if k < d else so_far
    i, j = np.nonzero(bound >= threshold - 1e-9)
    s = so_far[i, j]
    while k < d and len(i):
        to = min(k + step, d)
        s = s + np.einsum("ij,ij->i", ra[i, k:to], rb[j, k:to])
        left = sa[i, to] * sb[j, to] if to < d else 0.0
        stay = s + left >= threshold - 1e-9
        i, j, s, k = i[stay], j[stay], s[stay], to
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(i), 1 << 17):
        x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return out


def _roots(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column reaches through ``hit``."""
    top = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        low_a = np.minimum(a, np.where(hit, b[None, :], top).min(axis=1, initial=top))
        low_b = np.minimum(b, np.where(hit, low_a[:, None], top).min(axis=0, initial=top))
        if (low_a == a).all() and (low_b == b).all():
            return a, b
        a, b = low_a, low_b


def _compare(bases: dict[int, np.ndarray], threshold: float, tile: int) -> Callable:
    def unpack(tile: pa.StructScalar):
        ids = tile.values.field("rep").to_numpy(zero_copy_only=False)
        weights = tile.values.field("weight").to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(tile.values.field("unit").to_pylist()), np.float64)
        return ids, weights, raw.reshape(len(ids), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, first, second in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                left = unpack(first)
                right = left if own else unpack(second)
                for i in range(0, len(left[0]), tile):
                    for j in range(i if own else 0, len(right[0]), tile):
                        yield from met(*(x[i : i + tile] for x in left), *(x[j : j + tile] for x in right), own and i == j)

    def met(ids: np.ndarray, weights: np.ndarray, a: np.ndarray, ids2: np.ndarray, weights2: np.ndarray, b: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        hit = linked(a, b, bases[a.shape[1]], threshold)
        if own:
            np.fill_diagonal(hit, False)
            hit |= hit.T
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows):
            return
        hit = hit[np.ix_(rows, cols)]
        ra, rb = _roots(hit, ids[rows], ids2[cols])
        out = [(ids[rows], ra, hit @ weights2[cols])]
        if not own:
            out.append((ids2[cols], rb, hit.T @ weights[rows]))
        for node, root, n in out:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return compare


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = 1024, block_bytes: int = 4 << 20) -> DataFrame:
    """Link vectors of equal, non-null labels whose cosine is at least ``threshold``.

    Returns one row for each input row: ``id_col``, ``n_links`` (other rows linked directly),
    ``component_id`` (the least id reachable by links, itself included) and ``kept`` (its id is that). A
    vector that is null, empty or zero, or holds null or non-finite components, links with nothing, nor does
    one with a null id or label; vectors of different lengths do not link. Equal vectors link with each other, and so do
    rows that repeat an id, each of which counts as a link. An empty table gives an empty one. Columns other than the
    three are not read, whatever their names. Vectors travel in blocks of about ``block_bytes``. There is one basis for each length of vectors, on the driver: a square
    matrix of that length.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = source.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    grouped = usable.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = materialise(grouped.withColumn("rep", F.monotonically_increasing_id()))

    sums = classes.select("v").mapInArrow(_moments, "dim int, m array<double>").select("dim", F.posexplode("m").alias("at", "x")).groupBy("dim", "at").agg(F.sum("x").alias("x"))
    bases: dict[int, np.ndarray] = {}
    for dim, cells in ((r.dim, r.cells) for r in sums.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("cells")).collect()):
        moment = np.array([c.x for c in cells]).reshape(dim, dim)
        bases[dim] = np.ascontiguousarray(np.linalg.eigh(moment)[1][:, ::-1])

    width = float(np.sqrt(max(2 - 2 * threshold, 1e-6))) + 1e-9
    kind = vectors.schema[label_col].dataType.simpleString()
    placed = classes.select("rep", "label", "v", "weight").mapInArrow(_place(bases, width), f"rep long, label {kind}, weight long, dim int, slab int, unit binary")
    slabs = placed.groupBy("label", "dim", "slab").agg(F.ceil(F.count("*") * F.col("dim") * 8 / block_bytes).cast("int").alias("blocks"))
    dealt = placed.join(slabs, ["label", "dim", "slab"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = materialise(dealt.repartition(*_KEY).groupBy(*_KEY).agg(F.collect_list(F.struct("rep", "weight", "unit")).alias("rows")))

    keys = tiles.select(*_KEY)
    step = keys.select("label", "dim", F.explode(F.array("slab", F.col("slab") + 1)).alias("slab"), F.col("slab").alias("slab_a"), F.col("sub").alias("sub_a"))
    pairs = step.join(keys, ["label", "dim", "slab"]).where((F.col("slab") > F.col("slab_a")) | (F.col("sub") >= F.col("sub_a")))
    first = tiles.select("label", "dim", F.col("slab").alias("slab_a"), F.col("sub").alias("sub_a"), F.col("rows").alias("a"))
    met = pairs.join(first, ["label", "dim", "slab_a", "sub_a"]).join(tiles.withColumnRenamed("rows", "b"), _KEY)
    own = (F.col("slab") == F.col("slab_a")) & (F.col("sub") == F.col("sub_a"))
    found = materialise(met.select(own.alias("own"), "a", "b").mapInArrow(_compare(bases, threshold, tile), "a long, b long, n long"))

    groups = components(found, "a", "b")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    good = placed.select(F.col("rep").alias("good"))
    rows = classes.join(good, F.col("rep") == F.col("good"), "left").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep")).drop("node")
    least = rows.groupBy("component").agg(F.min("least").alias("found"))
    linked_to = F.when(F.col("good").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("weight") - 1)
    known = rows.join(least, "component").select("label", "v", linked_to.alias("links"), F.when(F.col("good").isNotNull(), F.col("found")).alias("found"))
    discard(tiles)
    joined = source.join(known, ["label", "v"], "left")
    usable_id = F.col("id").isNotNull()
    component = F.when(usable_id, F.coalesce("found", "id"))
    return joined.select(F.col("id").alias(id_col), F.when(usable_id, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
