"""Token counts by heap-and-linked-list byte-pair merging, without any identifiers.

The vocabulary file gives pieces and their ranks. A text's symbols stand in a linked
list, a heap holds the adjacent pairs that the vocabulary knows, and the lowest rank is
merged again and again: the count is the symbols at the start less the merges.
No piece has a space mark after another character, so no merge crosses the start of a
word, and a bounded cache keeps the counts of frequent words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import columns_of, id_text, id_type

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class MergeCounter:
    def __init__(self, path: str, cache_words: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in usable}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.rank):
            raise ValueError("this vocabulary joins words; they cannot be counted apart")
        self.limit = cache_words
        self.cache: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        """Symbols of one chunk less the merges. A character that the vocabulary lacks is
        as many symbols as it has bytes."""
        rank = self.rank
        n = len(chunk)
        symbols = sum(1 if c in rank else len(c.encode()) for c in chunk)
        piece = list(chunk)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, len(p)) for i in range(n - 1) if (p := chunk[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != size:
                continue  # one of the two has been merged meanwhile
            piece[i] += piece[j]
            piece[j] = ""
            symbols -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece[i] + piece[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, len(p)))
            h = before[i]
            if h >= 0 and (p := piece[h] + piece[i]) in rank:
                heapq.heappush(heap, (rank[p], h, len(p)))
        return symbols

    def chunk(self, chunk: str) -> int:
        found = self.cache.get(chunk)
        if found is None:
            if len(self.cache) >= self.limit:
                self.cache.clear()
            found = self.merged(chunk)
            if len(chunk) <= 64:
                self.cache[chunk] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a text: a mark stands before it and for each of its spaces."""
        if not text:
            return 0
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        got = list(map(self.cache.get, chunks))
        if None in got:
            got = [self.chunk(c) if g is None else g for c, g in zip(chunks, got, strict=True)]
        return sum(got)


_COUNTERS: dict[str, MergeCounter] = {}


def _counts(path: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = MergeCounter(path)
        count = _COUNTERS[path].count
        for batch in batches:
            (texts,) = columns_of(batch, "text")
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text.

    ``model`` is the path of a sentencepiece BPE file with byte fallback, the same on
    every executor. Null and empty texts have no bytes and no tokens; repeated rows are
    counted each; ids may be null.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    schema = f"doc_id {id_type(docs, id_col)}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return rows.mapInArrow(_counts(model, limit), schema)
