"""Packing of documents into fixed windows by Karmarkar-Karp multiway differencing.

Whole windows of a document stand alone. Its rest is cut into pieces of at most
``piece_tokens``; the pieces of about ``group_windows`` (512) windows form a group, which is
split into near-equal windows by differencing. A task packs the groups of its own
partition, so nothing is shuffled, a hot source or copy changes nothing, and a task
holds one group at a time.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from pagewarden.llm.common import columns_of, id_text, id_type
from pagewarden.llm.vocabulary import word_encoder


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items dealt to ``k`` sets of near-equal sums: the two partial partitions with the
    widest spread are merged, largest set to smallest set, until one is left.

    A partition is its sets in falling order without the empty ones; sums are kept less
    the smallest, and a set is a tree of pairs until the end.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(b)  # sets of b that are not empty meet the smallest of a
        if len(a) <= free:
            merged = a + b
        else:
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[free:], reversed(b[k - len(a) :]), strict=True)]
            merged = a[:free] + met + b[: k - len(a)]
        merged.sort(key=lambda s: -s[0])
        if len(merged) == k and merged[-1][0]:
            low = merged[-1][0]
            merged = [(s - low, t) for s, t in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    sets = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            else:
                items.append(node)
        sets.append(sorted(items))
    return sets


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises while one is too full."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return sets
        k += 1


def cuts(n: int, capacity: int, piece_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then the rest in smaller pieces."""
    whole = n // capacity * capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [
        (s, min(piece_tokens, n - s)) for s in range(whole, n, piece_tokens)
    ]


def _packer(path: str, end_id: int, capacity: int, piece_tokens: int, group_windows: int, with_ids: bool, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()
        next_id = (context.partitionId() if context else 0) << 40
        out: list[tuple] = []
        group: list[tuple] = []
        held = 0

        def place(pieces: list[tuple], sets: list[list[int]]) -> None:
            nonlocal next_id
            for items in sets:
                total = sum(pieces[i][2] for i in items)
                padded = total if total & (total - 1) == 0 else capacity
                offset = 0
                for i in items:
                    out.append((*pieces[i], next_id, offset, total, padded))
                    offset += pieces[i][2]
                next_id += 1

        def rows() -> pa.RecordBatch:
            full = [*zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(full, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                blob = encoder.encode(text) + end
                n = len(blob) // 4
                for start, length in cuts(n, capacity, piece_tokens):
                    part = blob[4 * start : 4 * (start + length)]
                    ids = (np.frombuffer(part, "<u4").astype("i4"),) if with_ids else ()
                    piece = (doc, start, length, zlib.crc32(part), n, *ids)
                    if length == capacity:
                        place([piece], [[0]])
                    else:
                        group.append(piece)
                        held += length
                if held >= group_windows * capacity:
                    place(group, windows([p[2] for p in group], capacity))
                    group, held = [], 0
                if len(out) >= 4096:
                    yield rows()
        if group:
            place(group, windows([p[2] for p in group], capacity))
        if out:
            yield rows()

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048,
    piece_tokens: int = 512, group_windows: int = 512, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: its document, place there, window and place in the window.

    ``tokenizer`` is the path of a tokenizers file, the same on every executor. With
    ``with_ids`` each piece carries its token ids, so a window is its pieces in order of
    ``offset``. A window is padded to ``capacity`` unless its length is a power of two
    (``padded_tokens``). A null or empty text is one piece, the end id alone; repeated
    rows are packed as often as they occur; a null id stays null; an empty table gives no
    rows. ``sequence_id`` is unique, not consecutive.
    """
    if not 0 < piece_tokens < capacity:
        raise ValueError("piece_tokens must lie between 1 and capacity - 1")
    ids = ", ids array<int>" if with_ids else ""
    schema = f"doc_id {id_type(docs, id_col)}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{ids}, sequence_id bigint, offset bigint, sequence_tokens bigint, padded_tokens bigint"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    run = _packer(tokenizer, end_id, capacity, piece_tokens, group_windows, with_ids, arrow)
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
