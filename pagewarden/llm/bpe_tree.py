"""BPE encoding by tree concatenation, and decoding.

A long text is halved until its leaves are short; leaves are encoded independently, and
the halves are then joined up the tree. At a join a window of both sides is encoded again;
it grows until it has a token in common with each of them, and replaces what lies between
the two. Where white space splits the text the parts are words.

A run without white space is cut by the tokenizer into the words that its pattern finds; a
long one of these is joined on its tokens. A sequence of tokens is the encoding of its
text exactly when every two neighbours are that of theirs, so one token in common on
either side is enough: each pair of neighbours in the joined sequence then stands in an
encoding already. Tokens are arrays of ids and ends, and a window is short whatever the
length of the sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewarden.llm.common import columns_of, id_text, id_type
from pagewarden.llm.vocabulary import WordEncoder, word_encoder

Tokens = tuple[np.ndarray, np.ndarray]  # ids, and ends in the word


def _bounds(n: int, leaf: int) -> list[int]:
    """Ends of equal leaves of at most ``leaf``; their number is a power of two."""
    parts = 1
    while -(-n // parts) > leaf:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


def _up(level: list, join: Callable) -> list:
    while len(level) > 1:
        level = [join(level[i], level[i + 1]) for i in range(0, len(level), 2)]
    return level[0]


class TreeEncoder:
    def __init__(self, words: WordEncoder, leaf_chars: int = 2048, run_chars: int = 1024):
        self.words, self.leaf, self.run = words, leaf_chars, run_chars
        self.tokenizer = words.tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token.removesuffix(suffix) if suffix else token)

    # long words of a run: arrays of token ids and of their ends
    def _tokens(self, word: str, a: int, b: int) -> Tokens:
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(word[a:b])], np.uint32)
        return ids, a + np.cumsum(self.length[ids])

    @staticmethod
    def _common(one: Tokens, other: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that two encodings have in common: same id, same end."""
        _, i, j = np.intersect1d(one[1], other[1], assume_unique=True, return_indices=True)
        same = one[0][i] == other[0][j]
        return i[same], j[same]

    def _join_tokens(self, word: str, left: tuple, right: tuple) -> tuple:
        (a, cut, before), (_, b, after) = left, right
        reach = 16
        while True:
            # a window begins and ends at token borders of the two sides
            i = int(np.searchsorted(before[1], cut - reach, "right"))
            j = int(np.searchsorted(after[1], cut + reach, "left"))
            start, end = int(before[1][i - 1]) if i else a, int(after[1][j]) if j < len(after[1]) else b
            window = self._tokens(word, start, end)
            at, low = self._common((before[0][i:], before[1][i:]), window) if i else ([], [])
            high, to = self._common(window, (after[0][: j + 1], after[1][: j + 1])) if end < b else ([], [])
            if (not i or len(at)) and (end == b or len(high)):
                first, last = (i + at[0], low[0]) if i else (0, 0)
                stop, rest = (high[-1], to[-1]) if end < b else (len(window[0]), len(after[0]))
                return a, b, tuple(np.concatenate([x[:first], w[last:stop], y[rest:]]) for x, w, y in zip(before, window, after, strict=True))
            reach *= 2

    def _long_word(self, word: str) -> bytes:
        at = _bounds(len(word), self.run)
        spans = [(a, b, self._tokens(word, a, b)) for a, b in zip(at, at[1:], strict=False)]
        return _up(spans, lambda x, y: self._join_tokens(word, x, y))[2][0].astype("<u4").tobytes()

    def encode_run(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # the library takes these out before it splits
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, known = [], {}
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text)):
            if len(word) > self.run:
                out.append(self._long_word(word))
                continue
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                known[word] = np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()
            out.append(known[word])
        return b"".join(out)

    # texts: parts are words
    def _parts(self, words: list[str]) -> list[bytes]:
        if max(map(len, words)) <= self.run:
            return self.words.encode_words(words)
        return [self.words.encode_word(w) if len(w) <= self.run else self.encode_run(w) for w in words]

    def _join_words(self, left: tuple, right: tuple) -> tuple:
        (lw, lp), (rw, rp) = left, right
        if not lw[-1] or not rw[0]:  # the cut lies beside white space: nothing to encode again
            return lw[:-1] + [lw[-1] + rw[0]] + rw[1:], lp[:-1] + [lp[-1] + rp[0]] + rp[1:]
        reach = 2
        while True:
            i, j = min(reach, len(lw)), min(reach, len(rw))
            words = lw[len(lw) - i : -1] + [lw[-1] + rw[0]] + rw[1:j]
            parts = self._parts(words)
            same_left = i == len(lw) or parts[0] == lp[len(lp) - i]
            same_right = j == len(rw) or parts[-1] == rp[j - 1]
            if same_left and same_right:
                return lw[: len(lw) - i] + words + rw[j:], lp[: len(lp) - i] + parts + rp[j:]
            reach *= 2

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        if len(text) <= self.leaf:
            return b"".join(self._parts(text.split(" ")))
        if " " not in text:
            return self.encode_run(text)
        at = _bounds(len(text), self.leaf)
        leaves = [text[a:b].split(" ") for a, b in zip(at, at[1:], strict=False)]
        _, parts = _up([(w, self._parts(w)) for w in leaves], self._join_words)
        return b"".join(parts)


def _coder(path: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(path)
        tree, decode = TreeEncoder(words), words.tokenizer.decode
        for batch in batches:
            (texts,) = columns_of(batch, "text")
            n, ids_sha, text_sha, ids_out, decoded_out = [], [], [], [], []
            for text in texts:
                blob = tree.encode(text)
                ids = np.frombuffer(blob, "<u4")
                decoded = decode(ids.tolist(), skip_special_tokens=False)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(blob).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype("i4"))
                    decoded_out.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(decoded_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every text and the text that they decode to, with their digests.

    ``tokenizer`` is the path of a tokenizers file that drops white space, the same on
    every executor. Null and empty texts have no ids and decode to an empty text; special
    strings inside a text are special tokens, as the library has it; repeated rows are
    encoded each. Without ``with_ids`` only the digests are returned.
    """
    more = ", ids array<int>, decoded string" if with_ids else ""
    schema = f"doc_id {id_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}"
    return id_text(docs, id_col, text_col).mapInArrow(_coder(tokenizer, with_ids), schema)
