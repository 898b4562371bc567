"""Near-duplicates with a MinHash LSH forest.

A document's set is its distinct five-word shingles. Equal sets are one class from the
start. A class has ``trees`` keys of ``depth`` MinHash values; each tree is a range-sorted
table of its keys, so that a huge group of copies is dealt over many tasks like anything
else. Rows that share a prefix of ``min_depth`` values form a region, and the region goes
deeper until it has at most ``small`` rows, all pairs of which are candidates. Larger
regions also give each row its neighbour in the order (the longest common prefix) and
the region's most central row, the one that shares the most prefixes with others over all
trees: in a large family of copies that is the text they were made from.
Candidates that the signatures do not rule out are confirmed on the full sets, but for
those whose ends are joined already. Then all pairs of the larger regions whose ends are
still apart are candidates too, in cells of two blocks of rows, a pair only in the first
tree that brings it together. A cell first says which of its rows have a partner that
size and signature allow; these come back with their sets, are confirmed in the cell, and
only links that join two components leave it, at most one less than its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import bit_place, bits_set, columns_of, id_bits, id_text, stored
from pagewarden.llm.components import components

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class Shingles:
    """Sorted distinct hashes of a text's shingles of ``width`` words."""

    def __init__(self, width: int = 5, cache_words: int = 300_000):
        self.width, self.limit, self.cache = width, cache_words, {}
        self.mix = np.resize(MIX, width)

    def _word(self, word: bytes) -> int:
        if len(self.cache) >= self.limit:
            self.cache.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.cache[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
        if not words:
            return np.zeros(0, np.uint64)
        got = list(map(self.cache.get, words))
        if None in got:
            got = [self._word(w) if g is None else g for w, g in zip(words, got, strict=True)]
        h = np.array(got, np.uint64)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            out = (out + h[j : len(h) - width + 1 + j]) * self.mix[j]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def _region(tree: int, prefix: bytes) -> int:
    """Name of the region of the rows that share a prefix in a tree."""
    return xxhash.xxh3_64_intdigest(prefix, seed=tree) - 2**63


def _sketcher(trees: int, depth: int, min_depth: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(2024)
        a = rng.integers(1, 2**63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, trees * depth, np.uint64)
        shingles = Shingles(width)

        def minima(values: np.ndarray) -> np.ndarray:
            low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(values), 4096):
                low = np.minimum(low, (a[:, None] * values[None, i : i + 4096] + b[:, None]).min(axis=1))
            return (low >> np.uint64(32)).astype(">u4")

        for batch in batches:
            n, digest, key, low, names = [], [], [], [], []
            for text in columns_of(batch, "text")[0]:
                s = shingles.of(text)
                m = minima(s) if len(s) else None
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                key.append(m.tobytes() if len(s) else None)
                low.append((m & 255).astype(np.uint8).tobytes() if len(s) else None)
                regions = [_region(t, key[-1][4 * t * depth : 4 * (t * depth + min_depth)]) for t in range(trees if len(s) else 0)]
                names.append(np.array(regions, np.int64).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, key, low, names))],
                names=["doc_id", "n_shingles", "digest", "key", "low", "names"],
            )

    return run


def _regions(keys: list[bytes], small: int, depth: int, level: int) -> Iterator[tuple[str, int, int, int]]:
    """("all" | "next" | "region", level, start, end) of sorted keys that share ``level`` values."""
    todo = [(0, len(keys), level)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= small:
            yield "all", d, lo, hi
            continue
        yield "region", d, lo, hi
        yield "next", d, lo, hi
        if d < depth:
            at = lo
            for _, rows in groupby(keys[lo:hi], key=lambda k: k[4 * d : 4 * d + 4]):
                size = sum(1 for _ in rows)
                todo.append((at, at + size, d + 1))
                at += size


def _walker(depth: int, min_depth: int, small: int) -> Callable:
    """Candidate pairs (b not null) and members of large regions of sorted rows; ``top`` is
    the name of a region of ``min_depth`` values of which some pairs are not among them: a
    large one, or the first or last of a partition, which may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        made = 0

        def of_region(at: tuple[int, bytes], keys: list[bytes], ids: list[int], edge: bool) -> pa.RecordBatch:
            nonlocal made
            a, b, region, size, top = [], [], [], [], []
            name = _region(*at)
            for kind, d, lo, hi in _regions(keys, small, depth, min_depth):
                if kind == "region":
                    made += 1
                    a += ids[lo:hi]
                    b += [None] * (hi - lo)
                    region += [base + made] * (hi - lo)
                    size += [hi - lo] * (hi - lo)
                    top += [name if d == min_depth else None] * (hi - lo)
                    continue
                pairs = combinations(ids[lo:hi], 2) if kind == "all" else zip(ids[lo : hi - 1], ids[lo + 1 : hi], strict=True)
                found = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
                a += [p[0] for p in found]
                b += [p[1] for p in found]
                region += [None] * len(found)
                size += [0] * len(found)
                top += [None] * len(found)
            if edge and len(keys) <= small:
                a += ids
                for column, value in ((b, None), (region, None), (size, 0), (top, name)):
                    column += [value] * len(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, region, size, top)], names=["a", "b", "region", "size", "top"])

        keys: list[bytes] = []
        ids: list[int] = []
        at = None
        first = True
        for batch in batches:
            for tree, key, doc in zip(*columns_of(batch, "tree", "key", "doc_id"), strict=True):
                if (here := (tree, key[: 4 * min_depth])) != at:
                    if at is not None and (first or len(keys) > 1):
                        yield of_region(at, keys, ids, first)
                    first = at is None
                    keys, ids, at = [], [], here
                keys.append(key)
                ids.append(doc)
        if at is not None:
            yield of_region(at, keys, ids, True)

    return run


def candidates(classes: DataFrame, *, trees: int, depth: int, min_depth: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of the forest over classes (doc_id, key); members
    (top, a) of the regions of which some pairs are not among them."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = rows.select("tree", F.substring("key", F.col("tree") * (4 * depth) + 1, F.lit(4 * depth)).alias("key"), "doc_id")
    ordered = rows.repartitionByRange(n, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    found = stored(ordered.mapInArrow(_walker(depth, min_depth, small), "a bigint, b bigint, region bigint, size bigint, top bigint"), "forest")
    members = found.filter("region is not null")
    central = members.withColumn("score", F.sum("size").over(Window.partitionBy("a")))  # a row is in few regions
    heads = central.groupBy("region").agg(F.max(F.struct("score", "a")).alias("h")).select("region", F.col("h.a").alias("h"))
    to_head = members.join(heads, "region").filter("a != h").select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b"))
    to_head = stored(to_head, "heads")  # apart from the distinct below, so that a hot region can be split
    return found.filter("b is not null").select("a", "b").union(to_head).distinct(), found.filter("top is not null").select("top", "a")


class _Cell:
    """Rows of a cell as arrays; ``left`` rows are held against the others."""

    def __init__(self, cell: pa.Table, percent: int, floor: float):
        self.percent, self.floor, self.top = percent, floor, cell.column("top")[0].as_py() if len(cell) else 0
        self.a, self.c, self.n, left, self.apart = (cell.column(x).to_numpy() for x in ("a", "c", "n", "left", "apart"))
        self.low = np.frombuffer(b"".join(cell.column("low").to_pylist()), np.uint8).reshape(len(self.a), -1)
        self.names = np.frombuffer(b"".join(cell.column("names").to_pylist()), np.int64).reshape(len(self.a), -1)
        self.left, self.right = np.flatnonzero(left), np.flatnonzero(~left)

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows on the right that may be linked with row ``i``, and how alike the signatures are."""
        r = self.right
        # of two rows outside the largest component each is on both sides: once is enough
        fits = (self.c[r] != self.c[i]) & (~self.apart[r] | (self.a[r] > self.a[i]))
        r = r[fits & (np.minimum(self.n[r], self.n[i]) * 100 >= np.maximum(self.n[r], self.n[i]) * self.percent)]
        alike = np.count_nonzero(self.low[r] == self.low[i], axis=1) / self.low.shape[1]
        r, alike = r[alike >= self.floor], alike[alike >= self.floor]
        first = (self.names[r] == self.names[i]).argmax(axis=1)  # the first tree in which the two meet
        here = self.names[i][first] == self.top
        return r[here], alike[here]


def _partners(percent: int, floor: float) -> Callable:
    """The rows of a cell that have a partner."""

    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, percent, floor)
        has = np.zeros(len(table), bool)
        for i in cell.left:
            found = cell.partners(i)[0]
            has[found] = True
            has[i] = len(found) > 0
        return table.filter(pa.array(has))

    return run


def _joins(percent: int, floor: float) -> Callable:
    """Links between rows of a cell that join two components, confirmed on the full sets."""

    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, percent, floor)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        above = {c: c for c in cell.c.tolist()}

        def find(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        found = []
        for i in cell.left:
            r, alike = cell.partners(i)
            todo, step = r[np.argsort(-alike, kind="stable")].tolist(), 1
            while todo:
                own = find(cell.c[i])
                todo = [x for x in todo if find(cell.c[x]) != own]
                some, todo, step = todo[:step], todo[step:], step * 4
                if not some:
                    continue
                size = np.array([len(sets[x]) for x in some])
                both = np.concatenate([sets[x] for x in some])
                at = np.minimum(np.searchsorted(sets[i], both), len(sets[i]) - 1)
                common = np.add.reduceat(sets[i][at] == both, np.cumsum(size) - size, dtype=np.int64)
                for x in np.array(some)[100 * common >= percent * (len(sets[i]) + size - common)].tolist():
                    if find(cell.c[x]) != find(cell.c[i]):
                        above[find(cell.c[x])] = find(cell.c[i])
                        found.append((int(min(cell.a[i], cell.a[x])), int(max(cell.a[i], cell.a[x]))))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def across(tops: DataFrame, part: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], *, percent: int, floor: float, cell_bytes: int) -> DataFrame:
    """Links (a, b) that join the components of ``part`` (node, component) across the regions of ``tops`` (top, a).

    Rows outside a region's largest component are compared with all of its rows, in cells
    of two blocks whose sets have about ``cell_bytes`` each. ``sets_of`` gives the sets
    (doc_id, members) of a table of ids (a).
    """
    node = classes.select(F.col("doc_id").alias("a"), "n")
    labelled = stored(tops.join(part.toDF("a", "c"), "a", "left").join(node, "a").select("top", "a", F.coalesce("c", "a").alias("c"), "n"), "tops")
    per = labelled.groupBy("top", "c").agg(F.sum("n").alias("n"))
    regions = per.groupBy("top").agg(F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n * 8 / F.lit(cell_bytes)).cast("bigint")
    regions = stored(regions.select("top", F.col("main.c").alias("main"), blocks(F.col("all")).alias("rows"), blocks(F.col("all") - F.col("main.n")).alias("others")), "regions")
    sides = labelled.join(regions, "top").join(classes.select(F.col("doc_id").alias("a"), "low", "names"), "a")
    sides = stored(sides.withColumn("apart", F.col("c") != F.col("main")), "sides")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    place, row = F.xxhash64("a"), ["a", "c", "n", "low", "names", "apart"]
    left = sides.filter("apart").select("top", F.pmod(place, "others").alias("i"), upto("rows").alias("j"), *row, F.lit(True).alias("left"))
    right = sides.select("top", upto("others").alias("i"), F.pmod(place, "rows").alias("j"), *row, F.lit(False).alias("left"))
    cells = left.union(right)
    kinds = "top bigint, i bigint, j bigint, a bigint, c bigint, n bigint, low binary, names binary, apart boolean, left boolean"
    partners = stored(cells.groupBy("top", "i", "j").applyInArrow(_partners(percent, floor), kinds), "partners")
    with_sets = partners.join(sets_of(partners.select("a").distinct()).toDF("a", "members"), "a")
    found = with_sets.groupBy("top", "i", "j").applyInArrow(_joins(percent, floor), "a bigint, b bigint")
    return stored(found, "joins")


def _alike(floor: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = columns_of(batch, "low_a", "low_b")
            if not x:
                continue
            left, right = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (x, y))
            alike = (left == right).mean(axis=1)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["a", "b", "alike"])
            yield found.filter(pa.array(alike >= floor))

    return run


def _setter(width: int, wanted: Broadcast) -> Callable:
    """Sets of the rows whose place is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            found = batch.filter(pa.array(bits_set(wanted.value, columns_of(batch, "place")[0])))
            sets = [shingles.of(t).tobytes() for t in columns_of(found, "text")[0]]
            yield pa.RecordBatch.from_arrays([found.column(0), pa.array(sets, pa.binary())], names=["doc_id", "members"])

    return run


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*columns_of(batch, "set_a", "set_b"), strict=True):
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likeliest(pairs: DataFrame, partners: int) -> DataFrame:
    """Pairs that are among the ``partners`` likeliest of either end."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "alike").union(pairs.select("b", "a", "alike"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("alike"), "y"))
    best = ends.withColumn("place", place).filter(F.col("place") <= partners)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, trees: int = 16, depth: int = 8,
    min_depth: int = 3, small: int = 24, slack: float = 0.15, partners: int = 4, filter_bits: int = 1 << 24, cell_bytes: int = 1 << 24,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts are linked when ``percent`` of the union of their sets, at least, is common. A
    text without words (null too) has an empty set and is linked with nothing; one of
    fewer than ``width`` words is one shingle. The component is the smallest id that links
    reach, itself included. Signatures rule out pairs whose estimate is more than
    ``slack`` below the threshold, over four standard errors. Ids must be whole numbers
    and name one document each: rows that repeat an id and text share its result, and a
    row with a null id is never kept. An empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketch = stored(rows.mapInArrow(_sketcher(trees, depth, min_depth, width), "doc_id bigint, n_shingles bigint, digest binary, key binary, low binary, names binary"), "sketch")
    classes = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *[F.first(x).alias(x) for x in ("key", "low", "names")])
    classes = stored(classes, "classes")
    pairs, tops = candidates(classes.select("doc_id", "key"), trees=trees, depth=depth, min_depth=min_depth, small=small)
    low = classes.select("doc_id", "n", "low")
    both = pairs.join(low.toDF("a", "n_a", "low_a"), "a").join(low.toDF("b", "n_b", "low_b"), "b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    floor = percent / 100 - slack
    likely = stored(both.filter(fits).select("a", "b", "low_a", "low_b").mapInArrow(_alike(floor), "a bigint, b bigint, alike double"), "likely")
    placed = rows.filter("doc_id is not null").select("doc_id", "text", bit_place(F.col("doc_id"), filter_bits).alias("place"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """Sets of the texts of ``ids`` (a), one row per id; the texts are read again and not
        shuffled: a bitmap of fixed size tells which are needed."""
        wanted = docs.sparkSession.sparkContext.broadcast(id_bits(ids, "a", filter_bits))
        return stored(placed.mapInArrow(_setter(width, wanted), "doc_id bigint, members binary"), "sets").dropDuplicates(["doc_id"])

    sets = sets_of(likely.select("a").union(likely.select("b")).distinct())

    def confirmed(some: DataFrame) -> DataFrame:
        paired = some.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        return stored(paired.mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")

    # the likeliest partners of each class join most of a family; of the other pairs only
    # those that would still join two components are looked at
    first = stored(_likeliest(likely, partners), "first")
    links = confirmed(first)
    part = components(links)
    ends = likely.join(first, ["a", "b"], "left_anti").join(part.toDF("a", "of_a"), "a", "left").join(part.toDF("b", "of_b"), "b", "left")
    rest = stored(ends.filter(~F.col("of_a").eqNullSafe(F.col("of_b")) | F.col("of_a").isNull()).select("a", "b"), "rest")
    if not rest.isEmpty():
        more = confirmed(rest)
        if not more.isEmpty():
            links = links.union(more)
            part = components(links)
    more = across(tops, part, classes, sets_of, percent=percent, floor=floor, cell_bytes=cell_bytes)
    if not more.isEmpty():
        part = components(links.union(more))
    of_class = classes.select("digest", F.col("doc_id").alias("first")).join(part.withColumnRenamed("node", "first"), "first", "left")
    of_class = of_class.select("digest", F.coalesce("component", "first").alias("component_id"))
    filled = sketch.filter("n_shingles > 0").join(of_class, "digest", "left").select("doc_id", "n_shingles", "component_id")
    out = filled.union(sketch.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_shingles", F.col("component_id").cast(docs.schema[id_col].dataType).alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns. Ids must name one document each."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).filter("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(kept, id_col, "left_semi")
