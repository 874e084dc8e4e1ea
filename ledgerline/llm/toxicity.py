"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are looked up by hash in an embedding table; filters of one, two and three words slide over the text, the
largest value of each filter is kept, and a logistic unit weighs them. Only the word position that gave a
filter its largest value has a gradient. Scores are shifted so that the threshold that fits best in each
language, as recognised by the function words of a text, stands at one common score.

Training reads a sample with its own share of each class; its loss weighs each class back to its true number of
rows. Thresholds are chosen on all labelled rows that training has not read, by a histogram of logits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .storage import bound_arrow, discard, materialise
from .textkit import LOWER, Texts, part, slices, texts_of, word_hashes, words_of

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "von", "den", "mit", "auf"],
    "fr": ["le", "les", "et", "des", "est", "une", "dans", "pour", "qui", "sur"],
    "es": ["el", "los", "las", "que", "una", "por", "con", "del", "para", "se"],
}

#: Bytes that are neither letters nor digits nor part of a character beyond ASCII.
_BETWEEN = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
_BUCKETS, _WIDTHS, _FILTERS, _DIM = 1 << 20, (1, 2, 3), 8, 8
#: Zero words after each text: its positions are those of its words and one of zero words, and no filter at them
#: reaches the next text.
_GAP = max(_WIDTHS)
#: Width of the bins in which logits are counted.
_STEP = 1 / 256


def _hash_words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the word bounds of texts."""
    data = LOWER[texts.data]
    words = words_of(Texts(data, texts.offsets), _BETWEEN)
    return (word_hashes(data, words) & np.uint64(_BUCKETS - 1)).astype(np.int32), words.bounds


@lru_cache(maxsize=1)
def _function_table() -> np.ndarray:
    """For each bucket, one bit for each language that has a function word in it."""
    table = np.zeros(_BUCKETS, np.uint8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        table[_hash_words(texts_of(pa.array([" ".join(words)])))[0]] |= np.uint8(1 << i)
    return table


def languages(buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the number of the language with most function words; ``len(FUNCTION_WORDS)`` for none."""
    bits, hits = _function_table()[buckets], []
    for i in range(len(FUNCTION_WORDS)):
        total = np.concatenate([[0], np.cumsum((bits >> i) & 1, dtype=np.int64)])
        hits.append(total[bounds[1:]] - total[bounds[:-1]])
    hits = np.stack(hits)
    return np.where(hits.max(axis=0) > 0, hits.argmax(axis=0), len(FUNCTION_WORDS))


@dataclass
class Network:
    #: Row of the embedding table for each bucket; row 0 is zero, for words too rare to learn from.
    rows: np.ndarray
    embedding: np.ndarray
    #: For each width and offset in it, one matrix from embedding to filters, side by side.
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float

    def spread(self, buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of texts with gaps between them, and where the positions of each text begin and end."""
        n = len(bounds) - 1
        starts = bounds[:-1] + _GAP * np.arange(n)
        out = np.zeros(len(buckets) + _GAP * n + _GAP, np.int32)
        where = np.arange(len(buckets)) + _GAP * np.repeat(np.arange(n), np.diff(bounds))
        out[where] = self.rows[buckets]
        return out, starts, starts + np.diff(bounds) + 1

    def activations(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Filter values at each position; ``table`` is the embedding times the filters."""
        each, n, at, out = table[rows], len(rows) - _GAP, 0, []
        for w in _WIDTHS:
            value = each[:n, at : at + _FILTERS].copy()
            for o in range(1, w):
                value += each[o : o + n, at + o * _FILTERS : at + (o + 1) * _FILTERS]
            out.append(value)
            at += w * _FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, buckets: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        table = self.embedding @ self.filters if table is None else table
        rows, starts, stops = self.spread(buckets, bounds)
        if not len(starts):
            return np.zeros(0)
        top = np.maximum.reduceat(self.activations(table, rows), np.column_stack([starts, stops]).ravel(), axis=0)[::2]
        return np.maximum(top + self.bias, 0) @ self.weights + self.intercept


def _ragged(buckets: np.ndarray, bounds: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)[pick]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return buckets[np.repeat(bounds[pick] - out[:-1], sizes) + np.arange(out[-1])], out


def _adam(state: dict, name: str, value: np.ndarray, gradient: np.ndarray, rate: float, t: int) -> np.ndarray:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m = 0.9 * m + 0.1 * gradient
    v = 0.999 * v + 0.001 * gradient**2
    state[name] = m, v
    return value - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def train(buckets: np.ndarray, bounds: np.ndarray, y: np.ndarray, counts: tuple[int, int], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> tuple[Network, np.ndarray]:
    """Fit on texts as bucket numbers with labels 0 and 1, which stand for ``counts`` rows of each label. A fifth
    of them is kept back for the thresholds; returns also the numbers of those that are not.

    Words in few texts share the zero row. The first coordinate of an embedding starts at the shrunk log odds
    of its word between the classes and the rest at random; training moves all of them."""
    rng = np.random.default_rng(seed)
    n = len(y)
    order = rng.permutation(n)
    own = order[n // 5 :]
    weight = np.array([counts[c] / max((y == c).sum(), 1) for c in (0, 1)])[y.astype(np.int64)]
    weight /= weight.mean() if n else 1
    least = max(2, round(8e-4 * len(own)))
    toxic, total = np.zeros(_BUCKETS), np.zeros(_BUCKETS)
    for i in own.tolist():
        seen = np.unique(buckets[bounds[i] : bounds[i + 1]])
        total[seen] += 1
        toxic[seen] += y[i]
    found = np.flatnonzero(total >= least)
    toxic, total = toxic[found], total[found]
    rows = np.zeros(_BUCKETS, np.int32)
    rows[found] = 1 + np.arange(len(found))
    p = max(y[own].sum(), 1.0)
    q = max(len(own) - y[own].sum(), 1.0)
    odds = np.log((toxic + 0.5) / (p + 1)) - np.log((total - toxic + 0.5) / (q + 1))
    embedding = np.zeros((1 + len(found), _DIM), np.float32)
    embedding[1:] = rng.normal(0, 0.05, (len(found), _DIM))
    embedding[1:, 0] = np.clip(odds, -4, 4) * total / (total + 2.0 * least)
    filters = rng.normal(0, 0.1, (_DIM, sum(_WIDTHS) * _FILTERS)).astype(np.float32)
    filters[0, : _FILTERS // 2] += 1
    k = len(_WIDTHS) * _FILTERS
    weights = rng.normal(0, 0.1, k)
    weights[: _FILTERS // 2] += 0.5
    net = Network(rows, embedding, filters, np.zeros(k, np.float32), weights, -2.0)
    state: dict = {}
    squares, t = np.zeros(embedding.shape), 0
    for _ in range(epochs if len(own) else 0):
        for pick in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            t += 1
            words, at = _ragged(buckets, bounds, pick)
            ids, starts, stops = net.spread(words, at)
            values = net.activations(net.embedding @ net.filters, ids)
            best = np.stack([a + values[a:b].argmax(axis=0) for a, b in zip(starts, stops, strict=True)])
            top = values[best, np.arange(k)] + net.bias
            active = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ net.weights + net.intercept, -40, 40))) - y[pick]) * weight[pick] / len(pick)
            through = (error[:, None] * net.weights) * (top > 0)
            g_filters, column, moved = np.zeros_like(net.filters), 0, []
            for i, w in enumerate(_WIDTHS):
                f = slice(i * _FILTERS, (i + 1) * _FILTERS)
                for o in range(w):
                    place = slice(column, column + _FILTERS)
                    word = ids[best[:, f] + o]
                    g_filters[:, place] = np.einsum("bfd,bf->df", net.embedding[word], through[:, f])
                    moved.append((word.ravel(), (through[:, f, None] * net.filters[:, place].T[None]).reshape(-1, _DIM)))
                    column += _FILTERS
            touched, row = np.unique(np.concatenate([w for w, _ in moved]), return_inverse=True)
            g_embedding = np.zeros((len(touched), _DIM))
            np.add.at(g_embedding, row, np.concatenate([g for _, g in moved]))
            net.intercept = float(_adam(state, "intercept", np.array(net.intercept), error.sum(), rate, t))
            net.weights = _adam(state, "weights", net.weights, active.T @ error + 1e-4 * net.weights, rate, t)
            net.bias = _adam(state, "bias", net.bias, through.sum(axis=0), rate, t).astype(np.float32)
            net.filters = _adam(state, "filters", net.filters, g_filters + 1e-4 * net.filters, rate, t).astype(np.float32)
            squares[touched] += g_embedding**2
            net.embedding[touched] -= rate * g_embedding / (np.sqrt(squares[touched]) + 1e-8)
            net.embedding[0] = 0
    return net, own


def best_threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit with the best F1, between two of the bins ``z`` with their weights of label 1 and 0."""
    if not toxic.sum():
        return 0.0
    z, where = np.unique(z, return_inverse=True)
    hits, misses = (np.cumsum(np.bincount(where, weights=w)[::-1]) for w in (toxic, clean))
    best = int((2 * hits / (hits + misses + toxic.sum())).argmax())
    z = np.append(z[::-1], z[0] - _STEP)
    return float((z[best] + z[best + 1]) / 2)


def thresholds(lang: np.ndarray, label: np.ndarray, seen: np.ndarray, z: np.ndarray, n: np.ndarray) -> list[float]:
    """The logit at which each language (and, last, text of none) is best parted, from numbers of rows in bins.

    Rows seen in training are left out, and the rest of each class is weighed up to all of it."""
    toxic, clean = np.where(label == 1, n, 0), np.where(label == 0, n, 0)
    scale = [w.sum() / max(w[~seen].sum(), 1) for w in (toxic, clean)]
    out = []
    for i in range(len(FUNCTION_WORDS) + 1):
        for chosen, (up, down) in ((~seen & (lang == i), scale), (~seen, scale), (np.ones(len(z), bool), (1.0, 1.0))):
            if toxic[chosen].sum() >= 5:
                break
        out.append(best_threshold(z[chosen], up * toxic[chosen], down * clean[chosen]))
    return out


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(2))
        for i, j in slices(texts):
            words, bounds = _hash_words(part(texts, i, j))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["id", "label", "words"])


def _judge(net: Network) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = net.embedding @ net.filters
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in slices(texts):
                words, bounds = _hash_words(part(texts, i, j))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(languages(words, bounds).astype(np.int32)), pa.array(net.logits(words, bounds, table).astype(np.float64)), *(c.slice(i, j - i) for c in batch.columns[2:])], ["id", "lang", "logit", *batch.schema.names[2:]])

    return judge


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, sample: int = 3000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score each whole text by a network trained on labelled rows that are not held out.

    Labels of ids without a row are left out first. Training takes at most ``sample`` texts of label 1 and twice as many of label 0, those with the least
    hashes of their ids, and weighs each class by its true number of rows; this is the only bound. Thresholds
    come from all labelled rows that are neither held out nor trained on, and scoring reads all rows, once.
    Returns for each input row
    ``id_col``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 where the score is at
    least ``threshold``), then the columns ``carry`` of the row. Labels other than 0 and 1 are left out; of several labels of one id the least
    counts. A null text counts as empty and is scored like any other; a null id is not held out and has no label. Repeated
    rows and ids are scored each by its own text, and learnt from as often as they stand. An empty table gives an empty
    one; without labels scores do not depend on what a text says. Columns other than those named are not read,
    whatever their names. Texts are read whole, long ones in one task.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    known = materialise(labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")).where(~held_out("id", folds, fold) & F.col("id").isNotNull()).join(texts.select("id"), "id", "left_semi"))
    first = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(n) for c, n in ((1, sample), (0, 2 * sample))]
    chosen = texts.join(first[0].unionByName(first[1]), "id")
    found = chosen.select(F.col("id").cast("string"), "label", "text").mapInArrow(_with_id, "id string, label int, words array<int>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    lists = found.column("words").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths()) if len(lists) else np.zeros(0, np.int64)
    words = lists.flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)
    counts = dict(known.join(texts.select("id"), "id").groupBy("label").count().collect())
    net, own = train(words.astype(np.int32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), found.column("label").to_numpy().astype(np.float64), (counts.get(0, 0), counts.get(1, 0)))
    judged = materialise(texts.mapInArrow(_judge(net), f"id {kind}, lang int, logit double{extra}"))
    trained = spark.createDataFrame([(i,) for i in sorted(set(found.column("id").take(pa.array(own)).to_pylist()))], "own string")
    bins = judged.join(known, "id").join(F.broadcast(trained), F.col("id").cast("string") == F.col("own"), "left")
    bins = bins.groupBy("lang", "label", F.col("own").isNotNull().alias("seen"), F.round(F.col("logit") / _STEP).alias("bin")).count().toArrow()
    lang, label, seen, z, n = (bins.column(i).to_numpy() for i in range(5))
    discard(known)
    at = thresholds(lang, label, seen.astype(bool), z * _STEP, n)
    shifted = F.col("logit") - F.element_at(F.array(*map(F.lit, at)), F.col("lang") + 1) + F.lit(float(np.log(threshold / (1 - threshold))))
    scored = judged.withColumn("score", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), shifted))))))
    return scored.select(F.col("id").alias(id_col), held_out("id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
