"""Nearest vectors inside one tenant."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagewarden.operators.ranking import top_k

METRICS = ("l2", "cosine")


def _distances(vectors: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of some vectors from one query; those that results carry."""
    if metric == "l2":
        return ((vectors - query) ** 2).sum(axis=1)
    return 1.0 - (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix; its values are not made into Python numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class _Best:
    """The ``k`` nearest vectors of each query of a cell, over vectors that stream by.

    What a batch can add is found in two steps. Distances to ``pivots`` rule out vectors: by
    the triangle inequality one is no nearer to a query than their distances to a pivot
    differ. For the rest one matrix product gives the squared distances to all queries, good
    to rounding errors; only vectors that come within those errors of a query's k-th best
    are measured exactly. For the cosine both steps take vectors of length one.
    """

    def __init__(self, ids: list, queries: np.ndarray, k: int, metric: str, pivots: int):
        self.ids, self.queries, self.k, self.metric, self.n_pivots = ids, queries, k, metric, pivots
        self.flat = queries if metric == "l2" else _unit(queries)
        self.square = (self.flat**2).sum(axis=1)
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.pivots: np.ndarray | None = None

    def _bounds(self) -> np.ndarray:
        """Squared distance beyond which a vector cannot enter a query's list."""
        far = np.array([b[-1][0] if len(b) == self.k else np.inf for b in self.best])
        return far if self.metric == "l2" else 2 * far

    def _squared(self, vectors: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by one product, and how far off they may be."""
        a, b = (vectors**2).sum(axis=1)[:, None], (others**2).sum(axis=1)[None, :]
        slack = (a + b) * (4 * vectors.shape[1] + 16) * np.finfo(np.float64).eps
        return np.maximum(a + b - 2 * vectors @ others.T, 0), slack

    def take(self, ids: list, vectors: np.ndarray) -> None:
        flat = vectors if self.metric == "l2" else _unit(vectors)
        bounds = self._bounds()
        rows = np.arange(len(ids))
        if self.pivots is None:
            self.pivots = flat[: self.n_pivots][np.isfinite(flat[: self.n_pivots]).all(axis=1)]
            self.to_pivots = np.sqrt(self._squared(self.queries if self.metric == "l2" else self.flat, self.pivots)[0])
        elif len(self.pivots) and np.isfinite(bounds).all():
            square, slack = self._squared(flat, self.pivots)
            apart = np.zeros((len(ids), len(self.ids)))
            for p in range(len(self.pivots)):
                near = np.abs(np.sqrt(square[:, p])[:, None] - self.to_pivots[None, :, p])
                apart = np.fmax(apart, near - 2 * np.sqrt(slack[:, p])[:, None])
            rows = np.flatnonzero(~(np.maximum(apart, 0) ** 2 > bounds[None, :] * (1 + 1e-9)).all(axis=1))
        square, slack = self._squared(flat[rows], self.flat)
        for q, best in enumerate(self.best):
            low = square[:, q] - slack[:, q]
            # of a batch only the k lowest upper ends can matter, beside the list so far
            edge = min(bounds[q] * (1 + 1e-9) + 1e-12, np.partition(square[:, q] + slack[:, q], self.k - 1)[self.k - 1] if len(rows) > self.k else np.inf)
            at = rows[~(low > edge)]  # a vector without a distance is measured too, and comes last
            exact = _distances(vectors[at], self.queries[q], self.metric)
            merged = best + [(d, ids[i]) for d, i in zip(exact.tolist(), at.tolist(), strict=True)]
            self.best[q] = sorted(merged, key=lambda x: (x[0] != x[0], 0.0 if x[0] != x[0] else x[0], x[1]))[: self.k]


def _walk(tenant: list[str], k: int, metric: str, pivots: int, schema: pa.Schema) -> Callable:
    """Rows come by cell, queries first: these are held, the vectors stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, queries, best = None, None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            if best is not None:
                found = [(*head, q, v, d) for q, rows in zip(best.ids, best.best, strict=True) for d, v in rows]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("_cell").to_numpy(), batch.column("is_vector").to_numpy(zero_copy_only=False)
            names = list(zip(*(batch.column(t).to_pylist() for t in tenant), strict=True)) if tenant else [()] * batch.num_rows
            cut = [0] + [i for i in range(1, batch.num_rows) if names[i] != names[i - 1] or cells[0][i] != cells[0][i - 1] or cells[1][i] != cells[1][i - 1]] + [batch.num_rows]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if (here := (names[lo], cells[0][lo])) != at:
                    yield from close()
                    at, head, queries, best = here, names[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not cells[1][lo]:
                    queries.append((part.column("query_id").to_pylist(), _matrix(part.column("vector"))))
                elif queries:
                    if best is None:
                        best = _Best([i for ids, _ in queries for i in ids], np.concatenate([m for _, m in queries]), k, metric, pivots)
                    best.take(part.column("vec_id").to_pylist(), _matrix(part.column("vector")))
        yield from close()

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, tenant: list[str], k: int = 5, metric: str = "l2",
    slice_rows: int = 200_000, query_block: int = 512, pivots: int = 8,
) -> DataFrame:
    """The ``k`` nearest vectors of each query among those of its own tenant.

    ``vectors``: tenant columns, ``vec_id, embedding``; ``queries``: tenant columns,
    ``query_id, query``. A tenant's vectors are dealt to slices of about ``slice_rows`` rows
    and its queries to blocks of about ``query_block``; a cell is one of each. A task holds a
    block of queries and ``k`` vectors for each of them, while the vectors of the slice
    stream by in Arrow batches, whatever the size of the tenant. Only the best ``k`` of a
    cell leave the task. Ties go to the lower ``vec_id``; null vectors and queries are left
    out.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    vectors, queries = vectors.filter("vec_id is not null and embedding is not null"), queries.filter("query is not null")
    many = lambda df, rows, name: df.groupBy(*tenant).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
    cells = many(vectors, slice_rows, "_slices").join(many(queries, query_block, "_blocks"), tenant)
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    slot = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    as_vector = lambda name: F.col(name).cast("array<double>").alias("vector")
    cell = (F.col("_slice") * F.col("_blocks") + F.col("_block")).alias("_cell")
    left = vectors.join(cells, tenant).withColumn("_slice", slot("vec_id", "_slices")).withColumn("_block", upto("_blocks"))
    left = left.select(*tenant, cell, F.lit(True).alias("is_vector"), none("query_id"), "vec_id", as_vector("embedding"))
    right = queries.join(cells, tenant).withColumn("_block", slot("query_id", "_blocks")).withColumn("_slice", upto("_slices"))
    right = right.select(*tenant, cell, F.lit(False).alias("is_vector"), "query_id", none("vec_id"), as_vector("query"))
    rows = left.unionByName(right).repartition(*tenant, "_cell").sortWithinPartitions(*tenant, "_cell", "is_vector")
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in tenant), f"query_id {kinds['query_id']}", f"vec_id {kinds['vec_id']}", "distance double"])
    out = rows.select(*tenant, "query_id", "vec_id", F.lit(0.0).alias("distance")).schema
    found = rows.mapInArrow(_walk(tenant, k, metric, pivots, to_arrow_schema(out)), schema)
    return top_k(found, [*tenant, "query_id"], [F.col("distance"), F.col("vec_id")], k)
