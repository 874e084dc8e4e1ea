"""Token counts by rank-synchronous merging of many pre-tokens at once.

Pre-tokens are found in numpy, by the kind of each character, over a slice of texts at once. Those that are new
lie end to end in one array of symbols: in each step every sequence finds its lowest-rank pair and merges
it wherever it stands, all sequences together; sequences without a known pair are done, and the symbols that
survive are counted. Their ids are kept in flat arrays of bounded size, found again by the bytes of the
pre-token themselves, so that no hash decides what is equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_arrow
from .textkit import slices, texts_of
from .vocabulary import Vocabulary, read, vocabulary

# The endings after "'" that are pre-tokens of their own.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD, _UNSEEN = range(6)
#: Bytes of a pre-token that its key holds, and what is left of eight bytes by how many of them count.
_KEY = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@lru_cache(maxsize=1)
def _tails() -> frozenset[str]:
    """Characters that may join the one before them when a text is normalised."""
    whole = map(chr, (c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000))
    return frozenset(x for c in whole if not unicodedata.is_normalized("NFD", c) for x in unicodedata.normalize("NFD", c)[1:])


class Characters:
    """The kind and the normal form of characters as the tokenizer library has them, asked of it when they are first seen.

    Hard are those whose normal form is another number of characters or may depend on their neighbours, those that
    Python's tables do not know, and the null character: what holds one is cut by the library itself."""

    def __init__(self, vocab: Vocabulary):
        self.tool, self.marked = vocab.library, vocab.library.normalizer is not None
        self.kind, self.small = np.full(0x110000, _UNSEEN, np.uint8), np.arange(0x110000, dtype=np.uint32)

    def _together(self, lead: str, chars: list[str]) -> np.ndarray:
        """Whether each character stays in one pre-token with ``lead`` before it. A line end stands between them."""
        found = [at for _, at in self.tool.pre_tokenizer.pre_tokenize_str("\n".join(lead + c for c in chars))]
        ends = dict(found)
        return np.array([ends.get(3 * i) == 3 * i + 2 for i in range(len(chars))])

    def _learn(self, cps: np.ndarray) -> None:
        chars = list(map(chr, cps.tolist()))
        if self.marked:
            normal = self.tool.normalizer.normalize_str
            forms = [normal(c) for c in chars]
            tails = _tails()
            hard = np.array([len(f) != 1 or c == "\0" or c in tails or unicodedata.category(c) == "Cn" or unicodedata.combining(c) != 0 or not unicodedata.is_normalized("NFC", c) for c, f in zip(chars, forms, strict=True)])
            chars = ["?" if h else f for f, h in zip(forms, hard.tolist(), strict=True)]
            self.small[cps] = [ord(c) for c in chars]
        else:
            hard = np.zeros(len(cps), bool)
        letter, digit, other = (self._together(lead, chars) for lead in "a1!")
        if self.marked:  # digits stand alone in such files, and white space is a blank by now
            space = np.array([c == " " for c in chars])
        else:
            space = ~(letter | digit | other)
        self.kind[cps] = np.select([hard, space, letter, other], [_HARD, _SPACE, _LETTER, _OTHER], _DIGIT)

    def of(self, cps: np.ndarray) -> np.ndarray:
        """Kinds; afterwards ``small`` holds the normal forms of these characters that are not hard."""
        kind = self.kind[cps]
        if (kind == _UNSEEN).any():
            self._learn(np.unique(cps[kind == _UNSEEN]))
            kind = self.kind[cps]
        return kind


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + sizes[i] - 1`` of each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Ranks:
    """Rank of a pair of symbols, by open addressing; ``_NONE`` for a pair that does not merge."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1), np.full(1 << bits, _NONE)
        key = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        todo, at = np.arange(len(key)), self._at(key)
        while len(todo):
            free = self.key[at] < 0
            self.key[at[free]] = key[todo[free]]
            own = self.key[at] == key[todo]
            self.rank[at[own]] = todo[own]
            todo, at = todo[~own], (at[~own] + 1) & self.last

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._at(key)
        held = self.key[at]
        out = np.where(held == key, self.rank[at], _NONE)
        todo = np.flatnonzero((held != key) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.last
            held = self.key[at]
            own = held == key[todo]
            out[todo[own]] = self.rank[at[own]]
            on = ~own & (held >= 0)
            todo, at = todo[on], at[on]
        return out


class Known:
    """Ids of pre-tokens by their bytes. What is new is numbered; when ``most`` are held, those stay that were
    asked for again, unless they are more than half."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self._clear(most)

    def _clear(self, places: int) -> None:
        self.last = 2 * places - 1
        self.slot = np.full(self.last + 1, -1, np.int32)
        self.key = np.zeros((1024, 2), np.uint64)
        self.start, self.size, self.again = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, bool)
        self.ids, self.n, self.n_ids = np.zeros(4096, np.uint32), 0, 0

    def room(self, entries: int, ids: int) -> None:
        def grown(x: np.ndarray, n: int) -> np.ndarray:
            return x if len(x) >= n else np.concatenate([x, np.zeros((max(n, len(x) * 3 // 2) - len(x), *x.shape[1:]), x.dtype)])

        self.key, self.start, self.size, self.again = (grown(x, self.n + entries) for x in (self.key, self.start, self.size, self.again))
        self.ids = grown(self.ids, self.n_ids + ids)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key, and the first keys of entries that are new, in the order of their entries."""
        if self.n + len(key) > (self.last + 1) // 2:
            self.forget(len(key))
        self.room(len(key), 0)
        h = (key[:, 0] ^ (key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        at = ((h ^ (h >> np.uint64(32))) & np.uint64(self.last)).astype(np.int64)
        out, todo, new = np.empty(len(key), np.int64), np.arange(len(key)), []
        while len(todo):
            held = self.slot[at]
            empty = np.flatnonzero(held < 0)
            if len(empty):
                place, claim = at[empty], np.arange(len(empty), dtype=np.int32)
                self.slot[place] = claim  # of several that want a place, one gets it
                first = empty[self.slot[place] == claim]
                ids = np.arange(self.n, self.n + len(first), dtype=np.int32)
                self.slot[at[first]] = ids
                self.key[ids] = key[todo[first]]
                self.again[ids] = False
                new.append(todo[first])
                self.n += len(first)
                held = self.slot[at]
            own = self.key[held]
            same = (own[:, 0] == key[todo, 0]) & (own[:, 1] == key[todo, 1])
            out[todo[same]] = held[same]
            todo, at = todo[~same], (at[~same] + 1) & self.last
        return out, np.concatenate(new) if new else np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray, first: int) -> None:
        """Ids of the entries from ``first`` on."""
        self.room(0, len(ids))
        n = first + len(sizes)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[first:n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[first:n] = sizes
        self.n_ids += len(ids)

    def forget(self, coming: int) -> None:
        keep = np.flatnonzero(self.again[: self.n])
        if len(keep) > self.most // 2:
            keep = keep[:0]
        key, sizes = self.key[keep], self.size[keep]
        ids = self.ids[ragged(self.start[keep], sizes.astype(np.int64))]
        places = self.most
        while places < len(keep) + coming:  # a very long text
            places *= 2
        self._clear(places)
        if len(keep):
            entry, first = self.find(key)
            order = np.argsort(entry)  # entries are numbered anew
            where = np.cumsum(sizes) - sizes
            self.add(ids[ragged(where[order].astype(np.int64), sizes[order].astype(np.int64))], sizes[order], 0)


class Counter:
    """Ids and counts of whole texts by one vocabulary with word-end marks."""

    def __init__(self, vocab: Vocabulary):
        if any(map(regex.compile(r"\s").search, vocab.special)):
            raise ValueError("special tokens with white space are not supported")
        self.vocab = vocab
        letter = {b: c for c, b in vocab.letters.items()}
        self.inner = np.array([vocab.ids[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab.ids[letter[b] + vocab.suffix] for b in range(256)], np.int64)
        self.ranks = Ranks(vocab.merges)
        self.whole = np.array([w for _, _, w in vocab.merges], np.int64)
        self.known = Known()
        self.characters = Characters(vocab)
        self.endings = [np.frombuffer(e.encode(), np.uint8) for e in ENDINGS]

    def merged(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that pre-tokens end with, one after the other, and how many each has; ``raw`` holds their
        bytes and ``sizes`` how many each has, one at least."""
        count, ends = len(sizes), np.cumsum(sizes) - 1
        symbols = self.inner[raw]
        symbols[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(count), sizes)
        rank = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.ranks.of(symbols[inside], symbols[inside + 1])
        done_symbols, done_owner = [symbols[:0]], [owner[:0]]
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            length = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(rank, starts)
            going = least != _NONE
            if not going.all():
                stay = np.repeat(going, length)
                done_symbols.append(symbols[~stay])
                done_owner.append(owner[~stay])
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                least, length = least[going], length[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            # of adjacent hits (x x x) the first, third ... merge
            run = np.concatenate([[0], np.cumsum(np.diff(hit) != 1)])
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            hit = hit[(np.arange(len(hit)) - first[run]) % 2 == 0]
            symbols[hit] = self.whole[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep)[hit] - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            near = np.zeros(len(symbols) + 1, bool)
            near[place] = True
            near[place - 1] = True  # of place 0 the last, which is past the end
            again = np.flatnonzero(near[:-1])
            rank[again] = _NONE
            again = again[again < len(symbols) - 1]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.ranks.of(symbols[again], symbols[again + 1])
        owner = np.concatenate(done_owner)
        return np.concatenate(done_symbols)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=count)

    def _hard(self, chunk: str) -> list[bytes | int]:
        """Pre-tokens, and ids of special tokens, of what stands between two white spaces."""
        out: list[bytes | int] = []
        for piece, special in self.vocab.segments(chunk):
            if special is not None:
                out.append(special)
            else:
                out += self.vocab.pre_tokens(piece)
        return out

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of texts: a byte array, where each begins and ends in it (a special token begins at minus its
        id), and how many pre-tokens stand before each text."""
        joined = "\n".join([*texts, ""])
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.characters.of(cps)
        small = self.characters.small[cps]
        n = len(cps)
        space = kind == _SPACE
        edge = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        edge[:n] |= kind == _DIGIT
        quotes = np.flatnonzero((small == 39) & edge[:n])
        for e in self.endings:
            own = quotes[quotes + len(e) < n]
            for i, c in enumerate(e.tolist()):
                own = own[small[own + 1 + i] == c]
            edge[own + 1] = False
            edge[own + 1 + len(e)] = True
        bounds = np.flatnonzero(edge)
        token = ~space[bounds[:-1]]
        starts, ends = bounds[:-1][token], bounds[1:][token]
        width = np.ones(n, np.int64) if joined.isascii() else 1 + (small >= 0x80) + (small >= 0x800) + (small >= 0x10000).astype(np.int64)
        data = np.frombuffer(small.tobytes().decode("utf-32-le").encode(), np.uint8)
        place = np.concatenate([[0], np.cumsum(width)])
        hard = np.flatnonzero(kind == _HARD)
        for s in self.vocab.special:
            at = joined.find(s)
            while at >= 0:
                hard = np.append(hard, at)
                at = joined.find(s, at + 1)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if not len(hard):
            return data, place[starts], place[ends], np.searchsorted(starts, first)
        # what stands between white spaces around a hard character is cut on its own
        gaps = np.flatnonzero(space)
        after = np.unique(np.searchsorted(gaps, hard))
        a, b = np.where(after > 0, gaps[after - 1] + 1, 0), gaps[after]
        inside = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)) > 0
        easy = ~inside[starts]
        more: list[bytes] = []
        at, where, size = [], [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            for item in self._hard(joined[x:y]):
                at.append(x)
                where.append(-1 if isinstance(item, bytes) else item)
                size.append(len(item) if isinstance(item, bytes) else 0)
                more.append(item if isinstance(item, bytes) else b"")
        sizes, where_ = np.array(size, np.int64), np.array(where, np.int64)
        begin = len(data) + np.cumsum(sizes) - sizes
        stop = begin + sizes
        begin = np.where(where_ >= 0, -where_, begin)
        spot = np.concatenate([starts[easy], np.array(at, np.int64)])
        order = np.argsort(spot, kind="stable")
        data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        return data, np.concatenate([place[starts[easy]], begin])[order], np.concatenate([place[ends[easy]], stop])[order], np.searchsorted(spot[order], first)

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The entry in ``known`` of each pre-token, and how many stand before each text. They hold until the next call."""
        data, starts, ends, first = self._cut(texts)
        known = self.known
        if not len(starts):
            return np.zeros(0, np.int64), first
        size = ends - starts
        short = (size <= _KEY) & (starts >= 0)
        if not data.all():  # a key does not tell how many null characters it ends with
            zeros = np.concatenate([[0], np.cumsum(data == 0)])
            short[short] = zeros[ends[short]] == zeros[starts[short]]
        tail = np.append(data, np.zeros(_KEY, np.uint8))
        words = np.ndarray((len(tail) - 7,), "<u8", tail, strides=(1,))
        if not short.all():
            rest = np.flatnonzero(~short)
            at, n = starts[short], size[short]
        else:
            rest, at, n = np.zeros(0, np.int64), starts, size
        key = np.empty((len(at), 2), np.uint64)
        key[:, 0] = words[at] & _MASK[np.minimum(n, 8)]
        key[:, 1] = words[at + 8] & _MASK[np.maximum(n - 8, 0)]
        found, new = known.find(key)
        known.again[found] = True
        if len(new):
            before = known.n - len(new)
            known.again[before : known.n] = False
            ids, sizes = self.merged(data[ragged(at[new], n[new])], n[new])
            known.add(ids, sizes, before)
        if not len(rest):
            return found, first
        out = np.empty(len(starts), np.int64)
        out[short] = found
        # long pre-tokens and special ones are entries of this call alone
        place: dict[bytes | int, int] = {}
        for i, a, b in zip(rest.tolist(), starts[rest].tolist(), ends[rest].tolist(), strict=True):
            out[i] = known.n + place.setdefault(data[a:b].tobytes() if a >= 0 else -a, len(place))
        items = [(k.to_bytes(4, "little") if isinstance(k, int) else k) for k in place]
        special = np.fromiter((isinstance(k, int) for k in place), bool, len(place))
        plain = [x for x, s in zip(items, special.tolist(), strict=True) if not s]
        ids, sizes = self.merged(np.frombuffer(b"".join(plain), np.uint8), np.fromiter(map(len, plain), np.int64, len(plain)))
        every = np.ones(len(items), np.int64)
        every[~special] = sizes
        flat, begin = np.zeros(int(every.sum()), np.int64), np.cumsum(every) - every
        flat[ragged(begin[~special], sizes)] = ids
        flat[begin[special]] = [k for k in place if isinstance(k, int)]
        known.room(len(items), 0)
        held = known.n_ids
        known.add(flat, every, known.n)
        known.n_ids = held  # the next call writes over them
        return out, first

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many stand before each."""
        entry, first = self.entries(texts)
        sizes = self.known.size[entry].astype(np.int64)
        flat = self.known.ids[ragged(self.known.start[entry], sizes)]
        return flat, np.concatenate([[0], np.cumsum(sizes)])[first]

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        entry, first = self.entries(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.known.size[entry], dtype=np.int64)])[first]).tolist()


class ByteCounter(Counter):
    """The same by a vocabulary without word-end marks, whose pre-tokens keep white space."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab)
        if vocab.library.normalizer:
            raise ValueError("vocabularies that keep white space and change characters are not supported")

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # a special token is a unit of its own, and what stands between two is cut like a text
        units, special, unit = [], [], [0]
        for t in texts:
            for piece, ident in self.vocab.segments(t):
                units.append(piece if ident is None else "")
                special.append(-1 if ident is None else ident)
            unit.append(len(units))
        joined = "".join(units)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind, n = self.characters.of(cps), len(cps)
        first = np.cumsum([0, *map(len, units)])
        wall = np.zeros(n + 1, bool)
        wall[first] = True
        edge = wall.copy()
        edge[1:n] |= kind[1:] != kind[:-1]
        # of white space before something else the last character stands alone, or goes with it if it is a blank
        after = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~wall[1:n]) + 1
        edge[after - 1] = True
        edge[after[cps[after - 1] == 32]] = False
        quotes = np.flatnonzero((cps == 39) & edge[:n])
        for e in self.endings:
            own = quotes[quotes + len(e) < n]
            for i, c in enumerate(e.tolist()):
                own = own[(cps[own + 1 + i] == c) & ~wall[own + 1 + i]]
            edge[own + 1] = False
            edge[own + 1 + len(e)] = True
        bounds = np.flatnonzero(edge)
        width = np.ones(n, np.int64) if joined.isascii() else 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000).astype(np.int64)
        place = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(joined.encode(), np.uint8)
        starts, ends, before = place[bounds[:-1]], place[bounds[1:]], np.searchsorted(bounds[:-1], first)
        named = np.array(special, np.int64)
        marked = np.flatnonzero(named >= 0)
        if len(marked):
            starts, ends = np.insert(starts, before[marked], -named[marked]), np.insert(ends, before[marked], 0)
            before = before + np.concatenate([[0], np.cumsum(named >= 0)])
        return data, starts, ends, before[unit]


@lru_cache(maxsize=2)
def counter(text: str) -> Counter:
    vocab = vocabulary(text)
    return (Counter if vocab.suffix else ByteCounter)(vocab)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Count bytes and tokens of each whole text.

    Returns for each input row ``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).
    Special strings inside a text count one token each, and none are added. A null text counts as empty: 0
    and 0. Ids are passed on as they are, null or repeated, and each row is counted for itself; an empty table gives
    an empty one; other columns are not read, whatever their names. A text is read whole in one task, whose memory
    grows with the longest text alone."""
    bound_arrow(docs.sparkSession)
    vocab = read(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(vocab)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = []
            for i, j in slices(texts):
                n += found.totals([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(texts.offsets)), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
