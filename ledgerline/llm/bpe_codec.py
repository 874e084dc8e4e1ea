"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token the last token of its encoding is unique. An automaton over all tokens gives
the tokens that end at a position. One of them is the last token there if the tokens before it, which end
with the last token of the shorter prefix, are not changed by what follows: this depends on the two tokens
alone, and is tested by undoing their merges from the latest on. Following the last tokens backwards
gives the ids that merging by rank gives, in time linear in the text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import byteorder

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_arrow
from .vocabulary import Memory, Vocabulary, read, vocabulary

# Fixed value: the pattern of byte-level pre-tokens, white space as in Unicode's property.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_WIDE_SPACE = regex.compile(r" \p{White_Space}|\p{White_Space} ")
_NEVER = 1 << 40


class Codec:
    def __init__(self, vocab: Vocabulary):
        if vocab.suffix:
            raise ValueError("the codec reads vocabularies without word-end marks")
        self.vocab = vocab
        size = len(vocab.bytes_of)
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.joined: dict[int, int] = {}
        for r, (a, b, whole) in enumerate(vocab.merges):
            self.rank[whole], self.left[whole], self.right[whole] = r, a, b
            self.joined[a << 20 | b] = r
        reached = [True] * size
        self.single: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        for i in sorted(vocab.ids.values(), key=self.rank.__getitem__):
            if self.rank[i] >= 0:
                a, b = self.left[i], self.right[i]
                reached[i] = reached[a] and reached[b] and self.compatible(a, b, self.rank[i])
            if reached[i]:
                word = vocab.bytes_of[i].decode("latin-1")
                self.single[word] = i
                automaton.add_word(word, (len(word), i))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.pairs = Memory(lambda k: self.compatible(k >> 20, k & 0xFFFFF), most=200_000)
        #: Encodings of what stands between two spaces, with the space before it.
        self.words = Memory(lambda w: self.encode_piece(" " + w))

    def compatible(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether text that ends in token ``a`` keeps it when token ``b`` follows: no merge across the seam comes
        before the merges that it would undo. Equal ranks go from left to right."""
        rank, joined = self.rank, self.joined
        while True:
            across = joined.get(a << 20 | b)
            if across is not None and across < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def pre_token(self, word: str) -> list[int]:
        """Ids of a pre-token whose bytes are the characters of ``word``."""
        whole = self.single.get(word)
        if whole is not None:
            return [whole]
        last, done, pairs = [0] * len(word), -1, self.pairs
        for end, (n, token) in self.matches(word):
            if end == done:
                continue
            before = end - n
            if before < 0 or pairs[last[before] << 20 | token]:
                last[end] = token
                done = end
        out, at, size = [], len(word) - 1, self.vocab.bytes_of
        while at >= 0:
            out.append(last[at])
            at -= len(size[last[at]])
        return out[::-1]

    def encode_piece(self, text: str) -> bytes:
        out: list[int] = []
        for piece, special in self.vocab.segments(text):
            if special is not None:
                out.append(special)
            else:
                for word in PRE_TOKEN.findall(piece):
                    out += self.pre_token(word.encode().decode("latin-1"))
        ids = array("I", out)
        if byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _WIDE_SPACE.search(text):  # a run of white space is one pre-token, so the text can't be cut at spaces
            return self.encode_piece(text)
        first, *rest = text.split(" ")
        return self.encode_piece(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        table = self.vocab.bytes_of
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(text: str) -> Codec:
    return Codec(vocabulary(text))


def _map_column(df: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    """``df`` with one more column, made in Arrow batches from ``column``; an input column named ``out`` gives way."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower() or c == column])
    source = kept if column != out else kept.withColumnRenamed(column, "_source")
    name = "_source" if column == out else column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(name)
            value = pa.array(map(work, batch.column(at).to_pylist()), arrow)
            columns = [c for i, c in enumerate(batch.columns) if not (i == at and name == "_source")]
            names = [n for n in batch.schema.names if n != "_source" or name != "_source"]
            yield pa.RecordBatch.from_arrays([*columns, value], [*names, out])

    schema = T.StructType([f for f in source.schema if f.name != "_source" or name != "_source"]).add(out, kind)
    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text as a binary column of little-endian unsigned 32-bit integers.

    Special strings inside a text give their special ids, and no others are added. A null text counts as
    empty and has no ids. All other columns stay; one with the name of the new column gives way to it. Each row is
    encoded for itself, repeated or not, whole and in one task; an empty table gives an empty one."""
    bound_arrow(docs.sparkSession)
    text = read(tokenizer_path)

    def make():
        found = codec(text)
        return lambda t: found.encode(t or "")

    return _map_column(docs, text_col, ids_col, T.BinaryType(), pa.binary(), make)


def decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that each row's ids stand for, special tokens included; bytes that are not UTF-8 become U+FFFD,
    and null counts as no ids."""
    bound_arrow(tokens.sparkSession)
    text = read(tokenizer_path)

    def make():
        found = codec(text)
        return lambda ids: found.decode(ids or b"")

    return _map_column(tokens, ids_col, text_col, T.StringType(), pa.string(), make)
