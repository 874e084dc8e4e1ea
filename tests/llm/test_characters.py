"""Ids of every character, in several places, as the tokenizer library gives them."""

from __future__ import annotations

import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from ledgerline.llm.token_counts import counter
from ledgerline.llm.vocabulary import read


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("form", ["{0}", "ab{0}cd {0}{0} 1{0}?", " {0} a{0}'s"])
def test_every_character(name, form):
    found, library = counter(read(tokenizer_path(name))), Tokenizer.from_file(tokenizer_path(name))
    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200), *range(0x10FF00, 0x110000))]
    texts = ["\n".join(map(form.format, every[i : i + 40])) for i in range(0, len(every), 40)]
    ids, bounds = found.ids(texts)
    wrong = [t for t, e, a, b in zip(texts, library.encode_batch(texts, add_special_tokens=False), bounds, bounds[1:], strict=False) if e.ids != ids[a:b].tolist()]
    assert not wrong
