"""Repeated passages by compaction of a de Bruijn graph of word windows.

An edge is a window of ``width`` words between the nodes of its first and its last
``width - 1`` words, named by 128 bits. Only edges in different texts matter, and these
are found in two passes: every window has a minimizer, the least hash of the six-word runs
in it, so windows that recur have minimizers that recur, and a minimizer is named once for
some five words. Edges whose minimizer recurs meet by name; each gets its source, the
first place of the smallest document that has it, and is nonbranching when the words
before and after it are the same everywhere. Nonbranching edges that follow each other in
their source are one path: wherever one of them occurs, all of them do. So only the first
edge of a path is looked up in the texts, and gives a whole span to remove.

At the end the words of each span are held against those at the path's coordinates in its
source; names that two windows share by chance would show there, and end the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import bit_place, bits_set, columns_of, id_bits, id_type, stored
from pagewarden.llm.words import U, bloom, in_bloom, join, pieces, signed

OUT = ["doc_id", "n_words", "n_removed", "kept_sha256"]
#: A place in the corpus as one number: document, 24 bits of its text's hash, 31 bits of word number.
TEXT_BITS, WORD_BITS = 24, 31
#: Bytes of text that a task looks at together. Its arrays take some hundred times as much where words are short.
PIECE = 1 << 19


def _minimizer_rows(width: int, run: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, (digest,) in pieces(batches, "digest", size=PIECE):
            at = words.windows(width)
            if not len(at):
                continue
            low, doc = words.minimizers(width, run)[at], words.doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            low, doc = low[new], doc[new]
            order = np.lexsort((low, doc))
            low, doc = low[order], doc[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([signed(low[new]), digest.take(pa.array(doc[new]))], names=["low", "digest"])

    return go


def _places(doc: np.ndarray, digest: np.ndarray, number: np.ndarray) -> pa.Array:
    """Document, text bits and word number as decimals, which order by document first."""
    below = ((digest & ((1 << TEXT_BITS) - 1)) << WORD_BITS) | number
    shift = TEXT_BITS + WORD_BITS
    halves = np.empty((len(doc), 2), np.int64)
    halves[:, 0] = ((doc.astype(np.int64).view(U) << U(shift)) + below.astype(U)).view(np.int64)
    halves[:, 1] = doc >> (64 - shift)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc), [None, pa.py_buffer(halves.tobytes())])


def _edge_rows(width: int, run: int, wanted: Broadcast, bits: int, heads: bool) -> Callable:
    """Edges whose minimizer is in the bitmap; with ``heads``, edges that are in it themselves."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, (ids, digests) in pieces(batches, "doc_id", "digest", size=PIECE):
            at = words.windows(width)
            if not len(at):
                continue
            e1 = words.runs(0, width)
            at = at[in_bloom(wanted, (e1 if heads else words.minimizers(width, run))[at], bits)]
            doc = words.doc[at]
            number = at - words.first_of[doc]
            place = _places(ids.to_numpy(zero_copy_only=False)[doc], digests.to_numpy(zero_copy_only=False)[doc], number)
            columns = [signed(e1[at]), signed(words.runs(1, width)[at]), place]
            if heads:
                yield pa.RecordBatch.from_arrays(columns, names=["e1", "e2", "place"])
                continue
            end = len(words.doc) - 1
            before = np.where(number > 0, words.lane[0][np.maximum(at - 1, 0)], U(1))
            after = np.where((at + width <= end) & (words.doc[np.minimum(at + width, end)] == doc), words.lane[0][np.minimum(at + width, end)], U(2))
            yield pa.RecordBatch.from_arrays([*columns, signed(join(before, after))], names=["e1", "e2", "place", "around"])

    return go


def _row_of(place: Column | str) -> Column:
    """Document and text bits of a place."""
    place = F.col(place) if isinstance(place, str) else place
    return ((place - _number(place)) / F.lit(1 << WORD_BITS).cast("decimal(10,0)")).cast("decimal(38,0)")


def _number(place: Column | str) -> Column:
    place = F.col(place) if isinstance(place, str) else place
    return F.pmod(place, F.lit(1 << WORD_BITS).cast("decimal(10,0)")).cast("decimal(38,0)")


def _doc_of(row: Column) -> Column:
    bits = F.lit(1 << TEXT_BITS).cast("decimal(8,0)")
    return ((row - F.pmod(row, bits)) / bits).cast("bigint")


def paths(edges: DataFrame) -> DataFrame:
    """Compacted paths (e1, e2 of the first edge; row, start, n) of edges (e1, e2, place, inner)."""
    rows = edges.select("e1", "e2", "inner", _row_of("place").alias("row"), _number("place").cast("bigint").alias("number"))
    along = Window.partitionBy("row").orderBy("number")
    follows = F.col("inner") & F.lag("inner").over(along) & (F.lag("number").over(along) == F.col("number") - 1)
    rows = rows.withColumn("first", ~F.coalesce(follows, F.lit(False)))
    rows = rows.withColumn("path", F.sum(F.col("first").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    named = [F.max(F.when(F.col("first"), F.col(e))).alias(e) for e in ("e1", "e2")]
    return rows.groupBy("row", "path").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"), *named).drop("path")


def _span(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


def _source_digests(width: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, row, spans in zip(*columns_of(batch, "text", "row", "spans"), strict=True):
                words = text.split()
                out += [(row, s["start"], _span(words, s["start"], s["n"] + width - 1)) for s in spans]
            types = (pa.decimal128(38, 0), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["row", "start", "digest"])

    return go


def _cut(width: int) -> Callable:
    """What is left of a text without its spans, each held against its source."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, digest, text, spans in zip(*columns_of(batch, "doc_id", "digest", "text", "spans"), strict=True):
                words = text.split()
                keep = np.ones(len(words), bool)
                for s in spans:
                    n = s["n"] + width - 1
                    if _span(words, s["at"], n) != s["source"]:
                        raise ValueError(f"two windows share a name (document {doc}, word {s['at']}): run again with other LANES")
                    keep[s["at"] : s["at"] + n] = False
                left = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                out.append((doc, digest, int((~keep).sum()), hashlib.sha256(left).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["doc", "digest", "n_removed", "sha"])

    return go


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in columns_of(batch, "text")[0]:
            words = text.split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "digest", "n_words", "sha"])


def spans(texts: DataFrame, *, width: int = 13, run: int = 6, bits: int = 1 << 26) -> DataFrame:
    """Spans to remove: (row, at, n) and the source's (source, start), for ``texts`` (doc_id, digest, text as bytes).

    ``row`` and ``source`` name a text as ``_row_of`` does; ``n`` windows from word ``at`` on
    also stand from word ``start`` on in the source, which has a smaller id.
    """
    lows = texts.select("digest", "text").mapInArrow(_minimizer_rows(width, run), "low bigint, digest bigint")
    again = lows.groupBy("low").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least < most")
    seen = bloom(stored(again.select("low"), "minimizers"), "low", bits)
    edges = texts.mapInArrow(_edge_rows(width, run, seen, bits, False), "e1 bigint, e2 bigint, place decimal(38,0), around bigint")
    edges = edges.groupBy("e1", "e2").agg(F.min("place").alias("place"), F.min("around").alias("a"), F.max("around").alias("z"), F.count(F.lit(1)).alias("n"))
    found = stored(paths(edges.filter("n > 1").select("e1", "e2", "place", (F.col("a") == F.col("z")).alias("inner"))), "paths")
    places = texts.mapInArrow(_edge_rows(width, run, bloom(found, "e1", bits), bits, True), "e1 bigint, e2 bigint, place decimal(38,0)")
    met = places.join(found.withColumnRenamed("row", "source"), ["e1", "e2"]).withColumns({"row": _row_of("place"), "at": _number("place").cast("bigint")})
    return stored(met.filter(_doc_of(F.col("row")) > _doc_of(F.col("source"))).select("row", "at", "n", "source", "start"), "spans")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, run: int = 6, bits: int = 1 << 26, id_filter: int = 1 << 24) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word goes when a window of ``width`` words that covers it also starts in a document
    with a smaller id, as the texts are before anything is removed. Of texts with the same
    words all but the smallest id's lose every word, if they have ``width``. Null texts have
    no words. Ids must be whole numbers; a row with a null id has no smaller and is smaller
    than none, so it keeps its words. Rows that repeat an id do not take from each other.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    whole = stored(rows.mapInArrow(_whole, "doc_id bigint, digest bigint, n_words bigint, sha binary"), "whole")
    copies = whole.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("sha", "first")
    whole = stored(whole.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"), "copies")

    known = rows.filter("doc_id is not null")
    found = spans(known, width=width, run=run, bits=bits)
    of_doc = found.withColumn("doc", _doc_of(F.col("row")))
    of_doc = of_doc.join(whole.filter("copy").select(F.col("doc_id").alias("doc")), "doc", "left_anti")
    of_doc = stored(of_doc, "spans-left")

    def texts(ids: DataFrame) -> DataFrame:
        """(doc, row, text, ...) of the texts that ``ids`` (row) names, picked by a bitmap before the join."""
        placed = known.withColumn("place", bit_place(F.col("doc_id"), id_filter))
        wanted = known.sparkSession.sparkContext.broadcast(id_bits(ids.select(_doc_of(F.col("row")).alias("doc")), "doc", id_filter))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(["doc_id", "digest", "text"]).filter(pa.array(bits_set(wanted.value, columns_of(batch, "place")[0])))

        picked = placed.mapInArrow(pick, "doc_id bigint, digest bigint, text binary")
        bits_of = F.pmod(F.col("digest"), F.lit(1 << TEXT_BITS))
        row = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << TEXT_BITS).cast("decimal(8,0)") + bits_of.cast("decimal(8,0)")
        return picked.withColumn("row", row.cast("decimal(38,0)"))

    needed = of_doc.groupBy("source", "start").agg(F.max("n").alias("n"))
    sources = needed.groupBy(F.col("source").alias("row")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    sources = stored(sources, "sources")
    sums = texts(sources).dropDuplicates(["row"]).join(sources, "row").select("row", "text", "spans").mapInArrow(_source_digests(width), "source decimal(38,0), start bigint, digest binary")
    sums = stored(sums, "source-sums")
    held = of_doc.join(sums, ["source", "start"]).groupBy("row").agg(F.collect_list(F.struct("at", "n", F.col("digest").alias("source"))).alias("spans"))
    held = stored(held, "held")
    cut = texts(held).join(held, "row").select("doc_id", "digest", "text", "spans").mapInArrow(_cut(width), "doc bigint, digest bigint, n_removed bigint, sha string")
    cut = stored(cut.withColumnsRenamed({"digest": "of", "sha": "left"}), "cut").dropDuplicates(["doc", "of"])

    joined = whole.join(cut, (F.col("doc_id") == F.col("doc")) & (F.col("digest") == F.col("of")), "left")
    all_gone = F.col("copy") & (F.col("n_words") >= width)
    zero = F.lit(0).cast("bigint")
    return joined.select(
        F.col("doc_id").cast(id_type(docs, id_col)).alias("doc_id"), "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ).select(*OUT)
