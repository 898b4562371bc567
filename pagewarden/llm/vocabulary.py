"""Word-wise use of a tokenizers file whose pre-tokenizer drops white space.

Such a tokenizer never joins what a space or a line feed separates: no canonical
composition crosses white space, and the split pattern only matches runs without it.
So a text is the concatenation of its space-separated words, and a bounded cache of
words saves encoding the frequent ones again.
"""

from __future__ import annotations

import os

import numpy as np

#: Punctuation that always is a pre-token of its own when letters stand before it. No
#: apostrophe (contractions) and no angle bracket or bar (special tokens) is among them.
TAIL = ".,!?#*$%&;:"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(shifted.get(b, b)) for b in range(256)]


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as ``tokenizers`` gives them
    with ``add_special_tokens=False``. ``cache_words`` bounds the memory."""

    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = cache_words
        self.cache: dict[str, bytes] = {"": b""}
        self.symbols = byte_symbols()

    def _plain(self, word: str) -> bool:
        """Latin letters alone: one pre-token, and normalising means lower-casing each letter."""
        return word.isalpha() and (word.isascii() or max(word) < "İ")

    def _one(self, word: str) -> bytes:
        core = word.rstrip(TAIL)
        if core and len(core) < len(word) and (core[-1].isalpha() and core[-1] < "İ"):
            return self.encode_word(core) + self.encode_word(word[len(core) :])
        if len(word) < 64 and self._plain(word):
            low = word.lower()
            if not low.isascii():
                low = "".join(self.symbols[b] for b in low.encode())
            return np.array([t.id for t in self.tokenizer.model.tokenize(low)], "<u4").tobytes()
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= self.limit:
                self.cache.clear()
                self.cache[""] = b""
            found = self._one(word)
            if len(word) <= 64:
                self.cache[word] = found
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        got = list(map(self.cache.get, words))
        if None in got:
            one = self.encode_word
            got = [one(w) if g is None else g for w, g in zip(words, got, strict=True)]
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_words(text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; Spark keeps workers, so later tasks find it warm."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
