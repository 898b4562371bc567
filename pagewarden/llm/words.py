"""Words of many texts at once as numpy arrays: bounds, names, windows; and filters of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import hash_bits

U = np.uint64
K = [U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]
#: Seeds of the two independent 64-bit names of a word.
LANES = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))
PIECE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * K[2]
    return x ^ (x >> U(32))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two neighbouring runs of words from the names of both."""
    return mix(mix(a) * K[0] + b * K[1])


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words:
    """Word bounds and names of texts, all at once: ``doc`` (text number), ``first`` and ``length``
    in ``data``, ``lane`` (two arrays of 64-bit names). ``table`` maps bytes first."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None):
        n = len(texts)
        wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        data = data if table is None else table[data]
        bounds = at - at[0]
        gap = spaces(data)
        inside = np.concatenate([[False], ~gap, [False]])
        starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]  # a text's end ends its last word
        starts[cut] = inside[cut + 1]
        ends[cut - 1] = inside[cut]
        self.first = np.flatnonzero(starts)
        self.length = np.flatnonzero(ends) + 1 - self.first
        self.doc = np.searchsorted(bounds, self.first, "right") - 1
        self.first_of = np.searchsorted(self.doc, np.arange(n + 1))
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.lane = self.names(np.arange(len(self.first)))

    def names(self, which: np.ndarray, width: int | None = None) -> list[np.ndarray]:
        """Two lanes of names of some words, or of their first ``width`` bytes."""
        first, length = self.first[which], self.length[which]
        length = length if width is None else np.minimum(length, width)
        eight = np.ndarray((len(self.data) - 7,), "<u8", buffer=self.data, strides=(1,))
        masks = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], U)
        lanes = [mix((length.astype(U) ^ seed) * K[3]) for seed in LANES]
        todo, step = np.arange(len(first)), 0
        while len(todo):
            left = length[todo] - step
            part = eight[first[todo] + step] & masks[np.minimum(left, 8)]
            for lane, k in zip(lanes, (K[0], K[1]), strict=True):
                lane[todo] = mix((lane[todo] ^ part) * k)
            todo, step = todo[left > 8], step + 8
        return lanes

    def number(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(len(self.doc)) - self.first_of[self.doc]

    def runs(self, lane: int, width: int) -> np.ndarray:
        """Names of all runs of ``width`` words (some cross texts)."""
        power, name, size = self.lane[lane], None, 0
        for bit in range(width.bit_length()):
            if width >> bit & 1:
                n = len(self.doc) - size - (1 << bit) + 1
                if n <= 0:
                    return np.zeros(0, U)
                name = power[:n] if name is None else join(name[:n], power[size : size + n])
                size += 1 << bit
            half = 1 << bit
            power = join(power[:-half], power[half:]) if len(power) > half else power[:0]
        return name

    def windows(self, width: int) -> np.ndarray:
        """Starts of the runs that lie in one text."""
        n = max(0, len(self.doc) - width + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :]) if n else np.zeros(0, np.int64)

    def minimizers(self, width: int, run: int) -> np.ndarray:
        """The least name among the runs of ``run`` words in every window."""
        low, need, have = self.runs(0, run), width - run + 1, 1
        while have < need:
            by = min(have, need - have)
            low, have = np.minimum(low[:-by], low[by:]), have + by
        return low


def pieces(batches: Iterator[pa.RecordBatch], *names: str, table: np.ndarray | None = None, size: int = PIECE) -> Iterator[tuple[Words, list[pa.Array]]]:
    """Words and the named columns of some rows at a time, so that arrays stay small."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + size, "right")))
            yield Words(texts.slice(lo, hi - lo), table), [c.slice(lo, hi - lo) for c in columns]
            lo = hi


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def two_places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (x & U(bits - 1)).astype(np.int64), ((x >> U(32)) & U(bits - 1)).astype(np.int64)


def bloom(rows: DataFrame, column: str, bits: int) -> Broadcast:
    """A bitmap of fixed size with two places for each hash."""
    both = rows.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 32))).alias("h"))
    return rows.sparkSession.sparkContext.broadcast(hash_bits(both, "h", bits))


def in_bloom(table: Broadcast, x: np.ndarray, bits: int) -> np.ndarray:
    words = np.frombuffer(table.value, U)
    one, two = ((words[p >> 6] >> (p & 63).astype(U)) & U(1) for p in two_places(x, bits))
    return (one & two).astype(bool)
