"""How far the sources of a language diverge in their words: frequent terms by iceberg
prefix refinement, smoothed shares, distances of sources, and over-used terms.

A level counts, for each byte prefix of a term, the documents of the language that hold a
term with it, and drops prefixes below the threshold; only terms with a surviving prefix
are looked at on the next level, whose prefixes are twice as long. A term that ends within
a level's width is complete there and is counted itself. Tasks read the texts anew on each
level, as arrays of word bounds and 128-bit names, count distinct prefixes per document,
combine a few megabytes of text, and ask a filter of fixed size which prefixes survived:
what it lets through by chance fails the exact count, which goes by the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import stored
from pagewarden.llm.words import U, Words, bloom, in_bloom, mix, pieces, signed

#: A-Z to a-z; ASCII bytes other than letters to a space; the bytes of all other characters as they are.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
BILLION = 1_000_000_000
PIECES = 8  # whose counts a task combines before it gives them out


class _Codes:
    """Numbers of the groups (of languages, or of languages and sources) that a task has met."""

    def __init__(self):
        self.groups: list[tuple] = []
        self.at: dict[tuple, int] = {}
        self.seed = np.zeros(0, U)

    def of(self, columns: list[pa.Array]) -> np.ndarray:
        """The number of each document's group."""
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        for r in set(rows) - self.at.keys():
            self.at[r] = len(self.groups)
            self.groups.append(r)
        return np.array([self.at[r] for r in rows], np.int64)

    def seeds(self) -> np.ndarray:
        """A hash of each group's language."""
        if len(self.seed) < len(self.groups):
            self.seed = np.array([xxhash.xxh64_intdigest(g[0]) for g in self.groups], U)
        return self.seed


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, and where runs of equal ones begin and how long they are."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(key)))


def _cut(words: Words, which: np.ndarray, width: int | None) -> pa.Array:
    """The bytes of some words, or their first ``width``."""
    length = words.length[which] if width is None else np.minimum(words.length[which], width)
    ends = np.cumsum(length)
    at = np.repeat(words.first[which] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.data[at].tobytes())])


class _Counts:
    """Counts by (group, name, ended) of several pieces; each keeps a word that shows its bytes."""

    def __init__(self, width: int | None):
        self.width, self.parts = width, []

    def add(self, words: Words, group: np.ndarray, which: np.ndarray, name: list[np.ndarray], n: np.ndarray) -> None:
        """``n`` more for the words ``which`` of a piece, in any order, keys repeated or not."""
        ended = np.ones(len(which), bool) if self.width is None else words.length[which] <= self.width
        key = mix(name[0] + U(2) * group.astype(U) + ended.astype(U)) ^ name[1]
        order, start, _ = _runs(key)
        total = np.add.reduceat(n[order], start) if len(start) else n[:0]
        keep = order[start] if len(start) else order
        self.parts.append((key[keep], group[keep], name[0][keep], ended[keep], total, _cut(words, which[keep], self.width)))

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Group, name, ended, count and bytes of all keys so far."""
        key, group, name, ended, n = (np.concatenate([p[i] for p in self.parts]) for i in range(5))
        shown = pa.concat_arrays([p[5] for p in self.parts])
        self.parts = []
        order, start, _ = _runs(key)
        if not len(start):
            return group, name, ended, n, shown
        first = order[start]
        return group[first], name[first], ended[first], np.add.reduceat(n[order], start), shown.take(pa.array(first))


def _strings(groups: list[tuple], which: np.ndarray, column: int) -> pa.Array:
    """One column of the groups by their numbers."""
    values = pa.array([g[column] for g in groups], pa.binary()).cast(pa.string())
    return values.take(pa.array(which)) if len(groups) else values


def _counted(column_names: list[str], width: int | None, look: Callable, out: Callable) -> Callable:
    """Count the words of (``column_names``, text) rows piece by piece.

    ``look(words, seed)`` gives the words to count with their names and amounts; ``seed`` is
    the hash of each word's language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _Codes(), _Counts(width)
        for words, columns in pieces(batches, *column_names, table=LETTERS):
            of_doc = codes.of(columns)
            group = of_doc[words.doc]
            which, name, n = look(words, codes.seeds()[group])
            counts.add(words, group[which], which, name, n)
            if len(counts.parts) >= PIECES:
                yield out(codes, *counts.take())
        if counts.parts:
            yield out(codes, *counts.take())

    return run


def _prefixes(width: int, before: int, alive: Broadcast | None, bits: int) -> Callable:
    """Documents of each (lang, prefix of ``width`` bytes) among terms longer than ``before`` with a live prefix."""

    def look(words: Words, seed: np.ndarray) -> tuple:
        which = np.flatnonzero(words.length > before)
        if before:
            which = which[in_bloom(alive, mix(words.names(which, before)[0] ^ seed[which]), bits)]
        name = words.names(which, width)
        ended = (words.length[which] <= width).astype(U)
        order, start, _ = _runs(mix(name[0] + U(2) * words.doc[which].astype(U) + ended) ^ name[1])
        once = order[start]  # a prefix counts once in a document
        return which[once], [lane[once] for lane in name], np.ones(len(once), np.int64)

    def out(codes: _Codes, group: np.ndarray, name: np.ndarray, ended: np.ndarray, n: np.ndarray, shown: pa.Array) -> pa.RecordBatch:
        place = mix(name ^ codes.seeds()[group]) if len(group) else name
        return pa.RecordBatch.from_arrays([_strings(codes.groups, group, 0), shown, pa.array(ended), pa.array(n), signed(place)], names=["lang", "prefix", "ended", "docs", "place"])

    return _counted(["lang"], width, look, out)


def frequent_terms(docs: DataFrame, *, min_docs: int, first_bytes: int = 8, growth: int = 2, bits: int = 1 << 24) -> DataFrame:
    """(lang, term, docs, place) of the terms in at least ``min_docs`` documents of ``docs`` (lang, text as bytes).

    ``place`` is a hash of language and term for ``bloom``.
    """
    width, before, alive, kept = first_bytes, 0, None, []
    while True:
        counted = docs.mapInArrow(_prefixes(width, before, alive, bits), "lang string, prefix binary, ended boolean, docs bigint, place bigint")
        counted = counted.groupBy("lang", "prefix", "ended").agg(F.sum("docs").alias("docs"), F.min("place").alias("place"))
        level = stored(counted.filter(F.col("docs") >= min_docs), "prefixes")
        kept.append(level.filter("ended").select("lang", F.col("prefix").cast("string").alias("term"), "docs", "place"))
        longer = level.filter("not ended")
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        alive = bloom(longer, "place", bits)
        width, before = width * growth, width


def _occurrences(kept: Broadcast, bits: int) -> Callable:
    """Occurrences of each (lang, source, term) whose term may be kept."""

    def look(words: Words, seed: np.ndarray) -> tuple:
        which = np.flatnonzero(in_bloom(kept, mix(words.lane[0] ^ seed), bits))
        return which, [lane[which] for lane in words.lane], np.ones(len(which), np.int64)

    def out(codes: _Codes, group: np.ndarray, name: np.ndarray, ended: np.ndarray, n: np.ndarray, shown: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_strings(codes.groups, group, 0), _strings(codes.groups, group, 1), shown.cast(pa.string()), pa.array(n)], names=["lang", "source", "term", "n"])

    return _counted(["lang", "source"], None, look, out)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact for any counts."""
    exact = lambda c: c.cast("decimal(19,0)")
    up = F.lit(BILLION).cast("decimal(10,0)") * (exact(n) + F.lit(5).cast("decimal(1,0)"))
    down = exact(total) + F.lit(5).cast("decimal(1,0)") * exact(terms)
    return F.lit(1).cast("bigint") + ((up - up % down) / down).cast("bigint")


def _cell(key: tuple, cell: pa.Table) -> pa.Table:
    """Distances of the pairs of sources of two blocks over the terms of one bucket.

    Rows without a term give a source's share of a term that it does not have.
    """
    lang, left, right, _ = (k.as_py() for k in key)
    plain = cell.filter(pc.is_null(cell.column("term")))
    place, share = plain.column("i").to_numpy(), plain.column("p").to_numpy()
    order = np.argsort(place)
    place, share = place[order], share[order]
    had = cell.filter(pc.is_valid(cell.column("term")))
    terms = had.column("term").combine_chunks().dictionary_encode()
    n = len(terms.dictionary)
    p = np.tile(share, (n, 1))
    p[terms.indices.to_numpy(zero_copy_only=False), np.searchsorted(place, had.column("i").to_numpy())] = had.column("p").to_numpy()
    block = plain.column("block").to_numpy()[order]
    a, b, far = [], [], []
    for x in range(len(place)):
        others = np.flatnonzero(np.arange(len(place)) > x) if left == right else np.flatnonzero(block == right) if block[x] == left else []
        if len(others):
            a += [place[x]] * len(others)
            b += place[others].tolist()
            far += np.abs(p[:, others] - p[:, x : x + 1]).sum(axis=0).tolist()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "far": pa.array(far, pa.int64()), "seen": pa.array([n] * len(a), pa.int64())})


def _pairs(shares: DataFrame, stats: DataFrame, sources: int, terms: int) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in cells of source blocks and term buckets."""
    of = stats.select("lang", "source", "i", F.col("base").alias("p"), F.expr(f"i div {sources}").alias("block"), F.expr(f"(sources + {sources - 1}) div {sources}").alias("blocks"), F.expr(f"greatest(1, (terms + {terms - 1}) div {terms})").alias("buckets"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    base = of.withColumn("bucket", upto("buckets")).select("lang", "i", "block", "blocks", "bucket", F.lit(None).cast("string").alias("term"), "p")
    had = shares.join(of.drop("p"), ["lang", "source"]).select("lang", "i", "block", "blocks", F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), "term", "p")
    cells = base.unionByName(had).withColumn("other", upto("blocks"))
    cells = cells.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "bucket", "i", "block", "term", "p")
    parts = cells.groupBy("lang", "left", "right", "bucket").applyInArrow(_cell, "lang string, a bigint, b bigint, far bigint, seen bigint")
    summed = stored(parts.groupBy("lang", "a", "b").agg(F.sum("far").alias("far"), F.sum("seen").alias("seen")), "distances")
    end = stats.select("lang", "i", "source", "base", "terms")
    both = summed.join(end.toDF("lang", "a", "source_a", "base_a", "terms"), ["lang", "a"]).join(end.drop("terms").toDF("lang", "b", "source_b", "base_b"), ["lang", "b"])
    value = F.col("far") + (F.col("terms") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b"))
    turned = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return both.select("lang", turned.alias("x"), value.alias("value")).select("lang", "x.source", "x.item", "value")


def audit(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50,
    block_sources: int = 64, bucket_terms: int = 4096, bits: int = 1 << 24,
) -> DataFrame:
    """lang, source, part, item, value and rank of every (lang, source) group of ``docs``.

    Terms are runs of letters and non-ASCII characters, A-Z in lower case. A language keeps
    the terms in at least ``min_docs`` of its documents; a document is a row, so a repeated
    row counts again. Shares p of kept terms are smoothed with 5 occurrences each, in
    billionths. Part ``pair``: sum of the differences in p to each other source of the
    language; a language without kept terms gives 0. Part ``term``: the ``top`` terms that
    a group has and uses more than its language. Ranks go by value downwards, then item.
    Null languages, sources and texts are empty; an empty table gives no rows.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(lang_col, empty).alias("lang"), F.coalesce(source_col, empty).alias("source"), F.coalesce(text_col, empty).alias("text"))
    raw = rows.select(*[F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")])
    kept = stored(frequent_terms(raw.select("lang", "text"), min_docs=min_docs, bits=bits), "kept-terms")
    counts = raw.mapInArrow(_occurrences(bloom(kept, "place", bits), bits), "lang string, source string, term string, n bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = stored(counts.join(kept.select("lang", "term"), ["lang", "term"]), "term-counts")

    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).select("lang", "source")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    stats = groups.join(terms, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("terms", zero).alias("terms"), F.coalesce("total", zero).alias("total"))
    per = Window.partitionBy("lang")
    stats = stats.withColumns({"i": (F.row_number().over(per.orderBy("source")) - 1).cast("bigint"), "sources": F.count(F.lit(1)).over(per), "base": F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"))).otherwise(0)})
    stats = stored(stats, "source-stats")
    shares = counts.join(stats.select("lang", "source", "terms", "total"), ["lang", "source"])
    shares = stored(shares.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")

    pairs = _pairs(shares, stats, block_sources, bucket_terms)
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(stats.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms")), "lang")
    q = stored(of_lang.select("lang", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q")), "language-shares")
    over = shares.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = [pairs.withColumn("rank", place).withColumn("part", F.lit("pair")), over.withColumn("rank", place).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
