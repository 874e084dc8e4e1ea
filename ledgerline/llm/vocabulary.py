"""Byte-pair vocabularies in the JSON format of public tokenizer libraries, and bounded memories of words."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, lru_cache

import regex
from tokenizers import Tokenizer


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself where it is printable, else one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges by rank and special tokens of one file, given as its text."""

    def __init__(self, text: str):
        found = json.loads(text)
        model = found["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("only byte-level byte-pair vocabularies without unknown tokens are read")
        for t in found["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError(f"special token {t['content']!r} has options that are not supported")
        self.steps = {k: found[k] for k in ("version", "normalizer", "pre_tokenizer")}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in found["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: Ids of the two parts and of the whole, by rank.
        self.merges: list[tuple[int, int, int]] = []
        for a, b in pairs:
            self.merges.append((self.ids[a], self.ids[b], self.ids[a + b]))
        self.letters = byte_letters()

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own normaliser and pre-tokenizer of the file, without its tokens."""
        return Tokenizer.from_str(json.dumps(self.steps | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))

    def pre_tokens(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special tokens, as the library cuts them."""
        tool = self.library
        if tool.normalizer:
            text = tool.normalizer.normalize_str(text)
        return [bytes(map(self.letters.__getitem__, piece)) for piece, _ in tool.pre_tokenizer.pre_tokenize_str(text)]

    @cached_property
    def special_pattern(self) -> regex.Pattern:
        return regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special tokens: ordinary pieces with None, special ones with their id."""
        if not any(map(text.__contains__, self.special)):
            return [(text, None)]
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes that each id stands for; a special token stands for its text."""
        out = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in self.ids.items():
            body = token.removesuffix(self.suffix) if self.suffix else token
            out[i] = bytes(self.letters[c] for c in body)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out


@lru_cache(maxsize=4)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


class Memory(dict):
    """``memory[word]`` is ``find(word)``, remembered. At ``most`` new words the older generation goes, so
    that frequent words stay and memory is bounded. Words longer than ``longest`` are never kept."""

    def __init__(self, find: Callable, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.find, self.most, self.longest, self.old = find, most, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.find(word)
            if isinstance(word, str) and len(word) > self.longest:
                return value
        self.keep(word, value)
        return value

    def keep(self, word, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value

    def unknown(self, words) -> list:
        """The different words of ``words`` that are not remembered."""
        return [w for w in set(words).difference(self) if w not in self.old]


def read(path: str) -> str:
    """A vocabulary file's text, read on the driver; a few MB that go to tasks with their function."""
    with open(path, encoding="utf-8") as f:
        return f.read()
