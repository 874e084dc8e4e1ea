"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and then towards a multiple of the
identity, and the Cholesky factor of the result is kept. A text's score is the logistic of the difference of
the two log densities: half the difference of squared Mahalanobis distances (two triangular products) plus log
determinants and priors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_arrow, materialise
from .textkit import Texts, part, slices, texts_of, word_hashes, words_of


def _bytes(chars: str | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = 1
    return out


_SETS = {
    "upper": _bytes(range(65, 91)),
    "lower": _bytes(range(97, 123)),
    "digit": _bytes(range(48, 58)),
    "stop": _bytes(".,;:?'\"()-"),
    "shout": _bytes("!"),
    "bar": _bytes("|<>{}[]\\/_="),
    "symbol": _bytes("#$%&*+@^~`"),
    "line": _bytes("\n"),
    "beyond": _bytes(range(128, 256)),
    "control": _bytes([*range(9), *range(14, 32), 127]),
}
#: The statistics of a text, in order.
STATISTICS = [*_SETS, "words", "word_length", "word_spread", "repeat", "distinct", "most", "lone", "capital", "marked", "line_again"]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def statistics(texts: Texts) -> np.ndarray:
    """One row of ``STATISTICS`` for each text, on scales where classes are near to normal."""
    data, offsets = texts
    words = words_of(texts)
    size, n = np.maximum(np.diff(offsets), 1), np.diff(words.bounds)
    some = np.maximum(n, 1)
    prefix = {k: np.concatenate([[0], np.cumsum(v[data], dtype=np.int64)]) for k, v in _SETS.items()}
    cols = [np.log1p(200 * (p[offsets[1:]] - p[offsets[:-1]]) / size) for p in prefix.values()]
    length = (words.ends - words.starts).astype(np.float64)
    mean = _per_text(length, words.bounds) / some
    spread = np.sqrt(np.maximum(0, _per_text(length * length, words.bounds) / some - mean * mean))
    within = {k: p[words.ends] - p[words.starts] for k, p in prefix.items()}
    h = word_hashes(data, words)
    same = np.concatenate([[0], (h[1:] == h[:-1]).astype(np.float64)]) if len(h) else np.zeros(0)
    first = words.bounds[:-1][n > 0]
    same[first] = 0
    distinct, most, again = np.zeros(texts.n), np.zeros(texts.n), np.zeros(texts.n)
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, words.starts)
    for i in np.flatnonzero(n).tolist():
        a, b = words.bounds[i], words.bounds[i + 1]
        own = np.sort(h[a:b])
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        distinct[i] = len(edge) / (b - a)
        most[i] = np.diff(np.append(edge, b - a)).max() / (b - a)
        cut = np.flatnonzero(np.concatenate([[True], line_of[a + 1 : b] != line_of[a : b - 1]]))
        if len(cut) > 1:
            lines = np.add.reduceat(h[a:b] * (np.arange(b - a, dtype=np.uint64) - np.repeat(cut, np.diff(np.append(cut, b - a))).astype(np.uint64) + np.uint64(1)), cut)
            again[i] = 1 - len(np.unique(lines)) / len(lines)
    share = lambda x: np.log1p(100 * _per_text(x, words.bounds) / some)
    cols += [np.log1p(n), np.log1p(mean), np.log1p(spread), share(same), distinct * np.log1p(n), np.log1p(100 * most)]
    cols += [share(length == 1), share((within["upper"] > 1) & (within["lower"] == 0)), share(within["symbol"] + within["shout"] + within["bar"] > 0), np.log1p(100 * again)]
    return np.column_stack(cols)


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    #: Inverse of each class's lower Cholesky factor.
    inverses: np.ndarray
    offset: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = [(((z - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(self.means, self.inverses, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.slope * (0.5 * (d[0] - d[1]) + self.offset), -40, 40)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = 0.1, ridge: float = 0.01, slope: float = 0.25) -> Discriminant:
    """From the count, sum and sum of outer products of each of the classes 0 and 1.

    ``pooled`` is the weight of the pooled covariance, ``ridge`` that of the identity. ``slope`` flattens the scores,
    for statistics of one text are not independent draws; it moves no decision at 0.5. A class without
    rows takes the other's moments, so that all scores are near the prior."""
    d = sums.shape[1]
    counts = counts.astype(float)
    total = counts.sum()
    if not total:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), 0.0, slope)
    centre = sums.sum(axis=0) / total
    spread = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / total - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, covariances = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        k = c if counts[c] else 1 - c
        mean = sums[k] / counts[k]
        means[c] = (mean - centre) / scale
        covariances[c] = (squares[k] / counts[k] - np.outer(mean, mean)) / np.outer(scale, scale)
    both = (counts[0] * covariances[0] + counts[1] * covariances[1]) / total
    inverses, logs = [], []
    for c in (0, 1):
        few = min(1.0, pooled + 2 * d / (counts[c] + 4 * d))
        s = (1 - few) * covariances[c] + few * both
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    prior = np.log((counts[1] + 1) / (counts[0] + 1))
    return Discriminant(centre, scale, means, np.stack(inverses), float(logs[0] - logs[1] + prior), slope)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(1))
        for i, j in slices(texts):
            x = statistics(part(texts, i, j))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat, *(c.slice(i, j - i) for c in batch.columns[2:])], ["id", "x", *batch.schema.names[2:]])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition and class: count, sum and sum of outer products."""
    d = len(STATISTICS)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        y = batch.column(0).to_numpy()
        for c in (0, 1):
            own = np.column_stack([np.ones((y == c).sum()), x[y == c]])
            sums[c] = sums.get(c, 0) + own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], ["label", "m"])


def _judge(model: Discriminant) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), *batch.columns[2:]], ["id", "score", *batch.schema.names[2:]])

    return judge


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score each whole text by a discriminant learnt from the labelled rows that are not held out.

    Returns for each input row ``id_col``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``
    (1 where the score is at least 0.5), then the columns ``carry`` of the row. Labels other than 0 and 1 are left out, and of several labels of one
    id the least counts. A null text counts as empty and is scored like any other; a null id is not held out and has no label. Repeated rows
    and ids are scored each by its own text. An empty table gives an empty one; without labels every score is 0.5.
    Columns other than those named are not read, whatever their names. Texts are read whole, long ones in one task. All
    labelled rows are learnt from; what comes to the driver is one matrix a class.
    """
    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    measured = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried).mapInArrow(_measure, f"id {kind}, x array<double>{extra}"))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    learnt = measured.where(~held_out("id", folds, fold)).join(known, "id").select("label", "x")
    cells = learnt.mapInArrow(_moments, "label int, m array<double>").select("label", F.posexplode("m").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    d = len(STATISTICS) + 1
    moments = np.zeros((2, d * d))
    for r in cells:
        moments[r.label, r["at"]] = r.v
    moments = moments.reshape(2, d, d)
    model = fit(moments[:, 0, 0], moments[:, 0, 1:], moments[:, 1:, 1:])
    scored = measured.mapInArrow(_judge(model), f"id {kind}, score double{extra}")
    return scored.select(F.col("id").alias(id_col), held_out("id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
