"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut into two halves; each half has its own codebook, so an
entry's cell is a pair of centroids. A query orders the centroids of each half by
distance and a heap walks the pairs by summed distance until the cells seen hold
``probe`` of all entries. The entries of those cells are reranked by the exact
cosine of the original vectors.

The index is dealt out over shards of whole cells that are neighbours, about
``shard_rows`` entries each; a cell with more is split over several by a hash of the
id, so a cell that holds a third of all entries is as even as any other. Queries
travel in blocks of ``block_queries`` to the shards that hold a cell they visit; a
shard returns each query's best k. Codebooks are fitted on at most about
``max_sample`` rows (chosen by a hash); every row is indexed. The driver holds
codebooks and one count for each cell.

``probe`` and ``centroids`` decide the recall: the share of entries that are
reranked is the same at every size.

Edge cases. Vectors that are null, empty, zero or hold null or non-finite numbers
take no part, nor do vectors of another length than most (the shorter length if equally many); nor rows without an
id. Finite numbers of any size count exactly. Other columns are ignored. Rows that repeat id and vector are one entry. Ties go to the smaller id.
Fewer than k other entries: all of them. No valid rows: no result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.llm.common import DRAWS, cut, draw, share_of_draws

RESULT = "query_id long, vec_id long, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """List column of equal lengths as a double matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return values.reshape(len(flat), -1)


def balanced(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: exact, and no square of it
    overflows or vanishes. Cosines do not change."""
    if not rows.shape[-1]:
        return rows
    _, exponent = np.frexp(np.abs(rows).max(axis=-1, keepdims=True))
    return np.ldexp(rows, -exponent)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=-1))


def cosine(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with q; equal rows give equal results."""
    rows, q = balanced(rows), balanced(q)
    return (rows * q).sum(axis=1) / (norms(rows) * norms(q))


def unit(x: np.ndarray) -> np.ndarray:
    x = balanced(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def codebook(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centroids of a bounded sample (Lloyd's rounds from random points)."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, points)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ c.T + (c * c).sum(1)


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(points, c).argmin(axis=1)


class Codebooks:
    """The two halves' centroids."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int):
        self.half = (sample.shape[1] + 1) // 2
        self.books = [codebook(h, centroids, seed + i) for i, h in enumerate(self.halves(unit(sample)))]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        a, b = (nearest(h, c) for h, c in zip(self.halves(unit(vectors)), self.books))
        return a * len(self.books[1]) + b

    def traverse(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """Cells in order of summed centroid distance until they hold the wanted number of entries."""
        d = [distances(h, c)[0] for h, c in zip(self.halves(unit(q[None])), self.books)]
        order = [np.argsort(x, kind="stable") for x in d]
        first, second = (x[o].tolist() for x, o in zip(d, order))
        heap, seen, out, held = [(first[0] + second[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(order[0][i]) * len(self.books[1]) + int(order[1][j])
            if sizes[cell]:
                out.append(cell)
                held += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(first) and y < len(second) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (first[x] + second[y], x, y))
        return np.array(out, dtype=np.int64)


def deal_cells(counts: list[tuple[int, int]], shard_rows: int) -> list[tuple[int, int, int, int]]:
    """(cell, first shard, shards, entries) for cells with their numbers of entries, in the order of the cells: whole
    cells share a shard up to ``shard_rows`` entries, a larger cell has several shards of its own."""
    dealt, at, filled = [], -1, shard_rows
    for cell, n in counts:
        parts = math.ceil(n / shard_rows)
        if parts > 1 or filled + n > shard_rows:
            at, filled = at + 1, 0
        dealt.append((cell, at, parts, n))
        at, filled = at + parts - 1, shard_rows if parts > 1 else filled + n
    return dealt


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, written to the checkpoint folder."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                       & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = cut(rows.distinct())
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == size[0].d) if size else rows


def search(df: DataFrame, is_query, k: int = 5, centroids: int = 64, probe: float = 0.42, max_sample: int = 10_000, shard_rows: int = 8_192,
           block_queries: int = 1_024, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where ``is_query`` (an expression on vec_id) holds."""
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col)
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    share = share_of_draws(max_sample, n)
    sample = (rows if share == DRAWS else rows.filter(draw("vec_id", "v") < share)).orderBy("vec_id").toPandas()
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1).toPandas()
    books = Codebooks(np.stack(sample["v"].to_numpy()), centroids, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(books.cell(matrix(b.column("v"))).astype(np.int32)), b.column("vec_id"), b.column("v")], names=["cell", "vec_id", "v"])

    entries = cut(rows.select("vec_id", "v").mapInArrow(assign, "cell int, vec_id long, v array<double>"))
    sizes = np.zeros(books.cells, np.int64)
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most centroids ** 2 rows
        sizes[r.cell] = r.n
    dealt = deal_cells([(int(c), int(sizes[c])) for c in np.flatnonzero(sizes)], shard_rows)
    where = F.broadcast(spark.createDataFrame([d[:3] for d in dealt], "cell int, first int, parts int"))  # at most centroids ** 2 rows
    shard = (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("parts"))).cast("int").alias("shard")
    entries = entries.join(where, "cell").select(shard, "cell", "vec_id", "v")
    cell_of = np.repeat([d[0] for d in dealt], [d[2] for d in dealt])
    shard_of = np.concatenate([np.arange(d[1], d[1] + d[2]) for d in dealt])
    begin = np.flatnonzero(np.diff(shard_of, prepend=-1))  # shards are numbered without gaps, in the order of their cells
    wanted = min(n, math.ceil(probe * n) + k + 1)

    def lists(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        v = matrix(t.column("v"))
        return pa.table({"shard": t.column("shard")[:1], "cells": pa.array([np.asarray(t.column("cell")).astype("<i4").tobytes()], pa.binary()),
                         "ids": pa.array([np.asarray(t.column("vec_id")).astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary())})

    index = entries.groupBy("shard").applyInArrow(lists, "shard int, cells binary, ids binary, vectors binary")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block_queries):
                part = b.slice(at, block_queries)
                v = matrix(part.column("v"))
                visit = np.zeros((len(v), books.cells), bool)
                for i, q in enumerate(v):
                    visit[i, books.traverse(q, sizes, wanted)] = True
                ids = np.asarray(part.column("vec_id"))
                needs = np.logical_or.reduceat(visit[:, cell_of], begin, axis=1)
                for s in np.flatnonzero(needs.any(axis=0)).tolist():
                    own = np.flatnonzero(needs[:, s])
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                        ids[own].astype("<i8"), v[own].astype("<f8"), np.packbits(visit[own], axis=1)))], names=["shard", "q_ids", "q_vectors", "visit"])

    queries = rows.filter(F.expr(is_query) if isinstance(is_query, str) else is_query).select("vec_id", "v")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(queries.count() / block_queries))
    blocks = queries.coalesce(tasks).mapInArrow(plan, "shard int, q_ids binary, q_vectors binary, visit binary")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cells, ids = np.frombuffer(r["cells"], "<i4"), np.frombuffer(r["ids"], "<i8")
                vectors = balanced(np.frombuffer(r["vectors"], "<f8").reshape(len(ids), -1))
                size = norms(vectors)
                q_ids = np.frombuffer(r["q_ids"], "<i8")
                q_vectors = balanced(np.frombuffer(r["q_vectors"], "<f8").reshape(len(q_ids), -1))
                visit = np.unpackbits(np.frombuffer(r["visit"], np.uint8).reshape(len(q_ids), -1), axis=1, count=books.cells).astype(bool)
                out = []
                for q, v, seen in zip(q_ids.tolist(), q_vectors, visit):
                    own = np.flatnonzero(seen[cells] & (ids != q))
                    score = (vectors[own] * v).sum(axis=1) / (size[own] * norms(v))
                    if len(own) > k:
                        best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                        own, score = own[best], score[best]
                    order = np.lexsort((ids[own], -score))[:k]
                    out += [(q, int(ids[own[i]]), float(score[i])) for i in order.tolist()]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = blocks.join(index, "shard").mapInArrow(rerank, RESULT).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
