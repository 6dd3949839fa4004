"""Operator 11: exact top-k by inner product, as a Voronoi join.

1. **Grouping.** Pivots are fitted by k-means on a bounded sample; every vector
   goes to the cell of its nearest pivot. Cells are cut into blocks of about
   ``BLOCK`` rows and queries of neighbouring cells put together into groups of about ``GROUP``.
2. **Bounds.** A cell's summary is its rows' least and greatest distance from the
   pivot and their greatest norm. With a threshold for each query (its k-th best score in
   one block of its own cell) a cell is necessary for a query when
   ``min(q.p + |q| far, |q| norm, (|q|^2 + norm^2 - gap^2) / 2)`` reaches the threshold, gap being the least
   distance that the triangle inequality leaves between the query and the cell's rows.
3. **Replication.** A block is sent to the query groups that need its cell, a query to the
   blocks of the cells that it needs, and nowhere else.
4. **Local solution.** A (group, block) pair is a blocked matrix product, exact
   (float64 while the products stay below 2**52, else int64); it gives at most k rows a query,
   and only those that reach the threshold. A window with a partial limit ranks them.

Scale: the pivots (at most ``MOST_PIVOTS``) and the cells' summaries are all that the driver sees.
A hot cell (copies of one vector) is many blocks, and its queries many groups. Where vectors
are spread so evenly that no bound excludes a cell, every query meets every block: that is the exact
search over all pairs, and only the k best per block and query leave it.

Edge cases: vectors that are null or hold null or non-finite components take no part;
an empty vector is all zeros, and a shorter one is filled with zeros; integers beyond +-2**28 are clamped, so
that scores fit a long; a row with null vec_id is no query, and as a candidate comes after its ties; a query's own
row is left out, other rows of its vec_id are not; repeated rows are candidates each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.llm.common import python_ready, written

#: Components become floor(SCALE * x); integers lie within +-CLAMP.
SCALE, CLAMP = 1024, 1 << 28
#: Rows to which pivots are fitted (the index holds every row); most pivots.
SAMPLE, MOST_PIVOTS = 4096, 1024
#: Rows of a block of data, and of a group of queries.
BLOCK, GROUP = 8192, 4096
#: Rows of one product.
TILE = 512

VECTORS = "row long, vec_id long, v array<int>, norm double, cell int, far double, is_query boolean"


def matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` float64, shorter lists filled with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    if len(lengths) * width == len(flat) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat
    return out


def integers(df: DataFrame, vec_col: str) -> tuple[Column, Column]:
    """(which rows take part, their integer vectors)."""
    x = df[vec_col].cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.isNotNull() & whole, F.transform(x, lambda c: F.greatest(F.lit(-float(CLAMP)), F.least(F.lit(float(CLAMP)), F.floor(c * float(SCALE)).cast("double"))).cast("int"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of ``a`` from all rows of ``b``."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def fitted(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most ``k`` pivots: k-means from distinct rows of the sample."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.random.default_rng(7).permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(axis=1)
        for j in np.unique(near):
            pivots[j] = sample[near == j].mean(axis=0)
    return pivots


class Cells:
    """Pivots and the summaries of their cells: all arrays over the cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, n = pivots, len(pivots)
        self.rows, self.queries = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.least, self.most, self.norm = np.zeros(n), np.full(n, -1.0), np.zeros(n)
        self.blocks, self.group, self.groups = np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)

    def summarised(self, rows: list) -> Cells:
        """``rows``: cell, rows, queries, least, most, norm; those of this cell only."""
        for r in rows:
            j = r["cell"]
            self.rows[j], self.queries[j] = r["rows"], r["queries"]
            self.least[j], self.most[j], self.norm[j] = r["least"], r["most"], r["norm"]
        self.blocks = np.maximum(1, -(-self.rows // BLOCK))
        self._grouped()
        return self

    def _grouped(self) -> None:
        """Neighbouring cells share a group of queries until it is full; a cell with more than that gets groups of its own."""
        left = set(np.flatnonzero(self.queries).tolist())
        apart, number = distances(self.pivots, self.pivots), 0
        while left:
            start = max(left, key=lambda j: (self.queries[j], -j))
            left.remove(start)
            self.group[start], self.groups[start] = number, max(1, -(-int(self.queries[start]) // GROUP))
            filled, number = int(self.queries[start]), number + int(self.groups[start])
            if self.groups[start] > 1:
                continue
            for j in sorted(left, key=lambda j: (apart[start, j], j)):
                if filled + self.queries[j] > GROUP:
                    break
                self.group[j], filled = self.group[start], filled + int(self.queries[j])
                left.remove(j)

    def necessary(self, q: np.ndarray, norms: np.ndarray, least_score: np.ndarray) -> np.ndarray:
        """For each query, which cells may hold a row of at least its threshold."""
        far, size = distances(q, self.pivots), norms[:, None]
        gap = np.maximum(0.0, np.maximum(far - self.most[None, :], self.least[None, :] - far))
        best = np.minimum(q @ self.pivots.T + size * self.most[None, :], size * self.norm[None, :])
        best = np.minimum(best, (size ** 2 + self.norm[None, :] ** 2 - gap ** 2) / 2)
        slack = 1.0 + 1e-6 * size * (self.norm + np.sqrt((self.pivots ** 2).sum(axis=1)))[None, :]  # float64 has 1e-8 of them at worst
        return (best + slack >= least_score[:, None]) & (self.rows > 0)[None, :]


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    if np.sqrt((q * q).sum(axis=1).max(initial=0.0) * (rows * rows).sum(axis=1).max(initial=0.0)) < 2.0 ** 52:
        return (q @ rows.T).astype(np.int64)
    return q.astype(np.int64) @ rows.astype(np.int64).T


def best_of(q: np.ndarray, q_rows: np.ndarray, least_score: np.ndarray, data: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the ``k`` best rows that reach the query's threshold; ``data`` is in the order of ties."""
    order = np.argsort(rows, kind="stable")
    for at in range(0, len(q), TILE):
        score = products(q[at:at + TILE], data)
        for i, s in enumerate(score):
            own = np.searchsorted(rows, q_rows[at + i], sorter=order)
            hit = s >= least_score[at + i]
            if own < len(rows) and rows[order[own]] == q_rows[at + i]:
                hit[order[own]] = False
            found = np.flatnonzero(hit)
            if len(found) > k:
                of = s[found]
                last = np.partition(of, len(of) - k)[len(of) - k]
                above = found[of > last]
                found = np.concatenate([above, found[of == last][:k - len(above)]])
            yield at + i, found, s[found]


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _by_tie(t: pa.Table) -> pa.Table:
    """Rows by vec_id, nulls last."""
    return t.sort_by([("vec_id", "ascending")])


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def in_cells(spark: SparkSession, df: DataFrame, cells: Cells, every: int, id_col: str, vec_col: str) -> DataFrame:
    """All rows that take part, with a row key and their cell, written."""
    pivots, width = cells.pivots, cells.pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 36
        for b in batches:
            for start in range(0, b.num_rows, 4 * TILE):
                part = b.slice(start, 4 * TILE)
                v = matrix(part.column(1), width)
                far = distances(v, pivots)
                cell = far.argmin(axis=1)
                rows = key + np.arange(part.num_rows, dtype=np.int64)
                key += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0), part.column(1), pa.array(np.sqrt((v * v).sum(axis=1))), pa.array(cell.astype(np.int32)),
                     pa.array(far[np.arange(len(cell)), cell]), part.column(2)], ["row", "vec_id", "v", "norm", "cell", "far", "is_query"])

    ok, v = integers(df, vec_col)
    vec_id = df[id_col].cast("long")
    rows = df.where(ok).select(vec_id.alias("vec_id"), v.alias("v"), F.coalesce(F.pmod(vec_id, F.lit(every)) == 0, F.lit(False)).alias("is_query"))
    return written(spark, rows.mapInArrow(assign, VECTORS), "cells")


def search(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
           pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all rows for every row whose id is divisible by ``every``."""
    return joined(spark, vectors, k, every, id_col, vec_col, pivots)[0]


def joined(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
           pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`search`, and the queries with their thresholds and the cells that they needed."""
    python_ready(spark)
    ok, v = integers(vectors, vec_col)
    n, width = vectors.where(ok).agg(F.count(F.lit(1)), F.max(F.size(vec_col))).collect()[0]
    width = max(width or 1, 1)
    drawn = vectors.where(ok & (F.pmod(F.xxhash64(vectors[id_col]), F.lit(max(n, 1))) < SAMPLE)).select(v.alias("v")).limit(2 * SAMPLE).toArrow()
    sample = matrix(drawn["v"], width) if drawn.num_rows else np.zeros((1, width))
    wanted = pivots or max(1, min(MOST_PIVOTS, int(n ** 0.5 / 4)))
    cells = Cells(fitted(sample, wanted))
    data = in_cells(spark, vectors, cells, every, id_col, vec_col)
    cells.summarised(data.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_query").cast("long")).alias("queries"), F.min("far").alias("least"),
        F.max("far").alias("most"), F.max("norm").alias("norm")).collect())

    def of_cell(values: np.ndarray, cell: str = "cell") -> Column:
        return F.get(F.lit(values.tolist()).cast("array<bigint>"), F.col(cell))

    block = F.pmod(F.xxhash64("row"), of_cell(cells.blocks)).cast("int")
    data = data.withColumn("block", block)
    asked = data.where("is_query").withColumn("grp", of_cell(cells.group) + F.pmod(F.xxhash64("row", F.lit(1)), of_cell(cells.groups)))

    def thresholds(q: pa.Table, near: pa.Table) -> pa.Table:
        near = _by_tie(near)
        qv, least = matrix(q["v"], width), np.full(q.num_rows, -np.inf)
        for i, found, score in best_of(qv, _column(q, "row"), least, matrix(near["v"], width), _column(near, "row"), k):
            if len(found) == k:
                least[i] = score.min()
        need = cells.necessary(qv, _column(q, "norm"), least)
        least = np.where(np.isinf(least), np.iinfo(np.int64).min, least)
        return pa.table({"grp": q["grp"], "row": q["row"], "query_id": q["vec_id"], "v": q["v"], "least": pa.array(least.astype(np.int64)),
                         "cells": pa.array([np.flatnonzero(x).astype(np.int32) for x in need], pa.list_(pa.int32()))})

    home = _anew(data.where("block = 0")).withColumn("grp", F.explode(F.sequence(of_cell(cells.group), of_cell(cells.group) + of_cell(cells.groups) - 1)))
    queries = asked.groupBy("grp", "cell").cogroup(home.where(of_cell(cells.queries) > 0).groupBy("grp", "cell")).applyInArrow(
        thresholds, "grp long, row long, query_id long, v array<int>, least long, cells array<int>")
    queries = written(spark, queries, "queries")

    needs = queries.select("grp", F.explode("cells").alias("cell")).distinct()
    sent = data.select("cell", "block", "row", "vec_id", "v").join(_anew(needs), "cell")
    calls = (queries.select("grp", "row", "query_id", "v", "least", F.explode("cells").alias("cell"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(cells.blocks).cast("int") - 1))))

    def solve(q: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _by_tie(rows)
        who, where, scores = [], [], []
        for i, found, score in best_of(matrix(q["v"], width), _column(q, "row"), _column(q, "least"), matrix(rows["v"], width), _column(rows, "row"), k):
            who.append(np.full(len(found), i))
            where.append(found)
            scores.append(score)
        who, where = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (who, where))
        return pa.table({"row": q["row"].take(who), "query_id": q["query_id"].take(who), "vec_id": rows["vec_id"].take(where),
                         "score": pa.array(np.concatenate([np.zeros(0, np.int64), *scores]))})

    key = ["grp", "cell", "block"]
    found = calls.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score"), queries

