"""Token ids of a word-level BPE tokenizer file, one word at a time with a bounded cache.

The tokenizer drops white space and never merges across it, so the ids of a text are those of
its words in turn. Words of plain letters, digits and punctuation go straight to the merge model;
any other word goes through the whole tokenizer. The results equal ``Tokenizer.encode`` of the
whole text without special tokens.
"""

from __future__ import annotations

import re

import numpy as np

#: Cached words per worker process; about 150 MB when full, then the cache starts anew.
CACHE = 500_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation without the apostrophe (contractions) and ``<`` (special tokens).
_MARKS = r"!-&(-/:;=-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_PART = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class WordEncoder(dict):
    """Maps a word (UTF-8 bytes) to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = cache
        self.parts: dict[str, bytes] = {}
        self.alphabet = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.cache:
            self.clear()
            self.parts.clear()
        text = word.decode()
        if _PLAIN.fullmatch(text):
            ids = b"".join([self.parts.get(p) or self._part(p) for p in _PART.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        ids = self.parts[part] = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer file, kept while the worker lives."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
