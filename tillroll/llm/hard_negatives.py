"""Hard negatives of anchors, mined through an inverted multi-index with certified stops.

Vectors of whole numbers are cut into two halves; each half has its own codebook, so
a row's cell is a pair of centroids. For an anchor a, a row x of cell (i, j) scores
at most a1.c1[i] + |a1| r1[i] + a2.c2[j] + |a2| r2[j], with r the largest distance of a
row's half from its centroid. Within a shard a heap walks the pairs by the sum of the
two half bounds; it stops once the next sum lies below what every window of the
anchor still needs. A window is a range of scores of which the best k rows are wanted:
any score for the positives, a range below each positive's score for its negatives.
Stops are certificates, so results are exact; the codebooks only decide how much is
skipped, which on vectors without structure is little.

Shards hold whole cells that are neighbours, at most ``shard_rows`` rows; a cell of
more rows is split over several. Anchors travel in blocks, in two rounds: to the
shards with the highest bounds, then to those of the others whose bound reaches what
the first round could not certify. Codebooks are fitted on at most about ``max_sample``
rows (chosen by a hash of the row); every row is indexed. The driver holds codebooks
and three numbers for each cell.

Edge cases. Rows with a null label or vector, or null or non-finite components, take no
part, nor do rows without an id, vectors of another length than most, empty vectors, or
components of 2**54 and more (no long holds 256 times them). Rows equal in id, label and
vector are one row; other rows may share an id. Scores are exact; those beyond the range
of longs are reported as its ends. Fewer rows than asked for: all. Empty tables and tables
without anchors: no result. Very long vectors and extra columns need no care.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import DRAWS, cut, draw, share_of_draws
from tillroll.llm.multi_index import codebook, deal_cells, distances
from tillroll.llm.words import give_back

LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "a long, key int, vec_id long, score long"
BATCH = 1_024  # rows scored at a time


def int_matrix(column: pa.Array) -> np.ndarray:
    """List column of equal lengths as a matrix of longs."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(flat), -1)


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with a, as longs (beyond them: their ends)."""
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0) * max(float(np.abs(a.astype(np.float64)).max(initial=0)), 1.0) * max(len(a), 1)
    if most < 2**53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return x @ a
    return np.array([min(max(int(s), LEAST), MOST) for s in x.astype(object) @ a.astype(object)], dtype=np.int64)


class Halves:
    """The codebooks of the two halves."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int):
        self.half = (sample.shape[1] + 1) // 2
        self.books = [codebook(h, centroids, seed + i) for i, h in enumerate(self.split(sample.astype(np.float64)))]
        self.width = len(self.books[1])

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row, and the distances of its halves from their centroids (never too small)."""
        near, far = [], []
        for h, c in zip(self.split(x.astype(np.float64)), self.books):
            at = distances(h, c).argmin(axis=1)
            near.append(at)
            far.append(np.sqrt(((h - c[at]) ** 2).sum(axis=1)) * (1 + 1e-9))
        return near[0] * self.width + near[1], far

    def bounds(self, a: np.ndarray, radii: list[np.ndarray]) -> list[np.ndarray]:
        """For each anchor and centroid of a half: the most that half of a row can score (never too small)."""
        out = []
        for h, c, r in zip(self.split(a.astype(np.float64)), self.books, radii):
            norm = np.sqrt((h * h).sum(axis=1))[:, None]
            b = h @ c.T + norm * r
            out.append(b + 1e-9 * (norm * np.sqrt((c * c).sum(axis=1)) + norm * r) + 0.5)
        return out


class Windows:
    """An anchor's windows: the best k scores of each range so far."""

    def __init__(self, keys, low, high, need, k: int):
        self.keys, self.low, self.high, self.k = keys, low, high, k
        self.need = np.maximum(low, need)  # lower scores are not wanted
        self.ids = [np.zeros(0, np.int64)] * len(keys)
        self.scores = [np.zeros(0, np.int64)] * len(keys)
        self._settle()

    def _settle(self) -> None:
        self.floor, self.ceiling = (int(self.need.min()), int(self.high.max())) if len(self.keys) else (MOST, LEAST)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        own = np.flatnonzero((scores >= self.floor) & (scores <= self.ceiling))
        if not len(own):
            return
        ids, scores = ids[own], scores[own]
        for w in range(len(self.keys)):
            fit = np.flatnonzero((scores >= self.need[w]) & (scores <= self.high[w]))
            if not len(fit):
                continue
            i, s = np.concatenate([self.ids[w], ids[fit]]), np.concatenate([self.scores[w], scores[fit]])
            if len(s) > self.k:
                order = np.lexsort((i, ~s))  # ~s falls as s grows, without overflow
                i, s = i[order[:self.k]], s[order[:self.k]]
            if len(s) == self.k:
                self.need[w] = max(int(self.need[w]), int(s.min()))
            self.ids[w], self.scores[w] = i, s
        self._settle()


class Shard:
    """Rows of some cells, in order of the cells, as one table row."""

    SCHEMA = "shard int, cells binary, starts binary, radii binary, ids binary, labels binary, vectors binary"

    def __init__(self, row: dict, books: Halves):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.books, self.cells, self.starts = books, read("cells", "<i4"), read("starts", "<i8")
        self.ids, self.labels = read("ids", "<i8"), read("labels", "<i8")
        self.x = read("vectors", "<i8").reshape(len(self.ids), -1)
        most = float(np.abs(self.x.astype(np.float64)).max(initial=0)) * max(self.x.shape[1], 1)
        self.most, self.fast = most, self.x.astype(np.float64) if most < 2**53 else None
        radii = read("radii", "<f8")
        self.radii = [radii[:len(books.books[0])], radii[len(books.books[0]):]]
        self.slot = {int(c): n for n, c in enumerate(self.cells)}
        self.present = [np.unique(self.cells // books.width), np.unique(self.cells % books.width)]

    @staticmethod
    def pack(t: pa.Table, books: Halves) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        cell = np.asarray(t.column("cell"))
        cells, starts = np.unique(cell, return_index=True)
        radii = [np.zeros(len(b)) for b in books.books]
        np.maximum.at(radii[0], cell // books.width, np.asarray(t.column("far1")))
        np.maximum.at(radii[1], cell % books.width, np.asarray(t.column("far2")))
        values = {"cells": cells.astype("<i4"), "starts": np.append(starts, len(cell)).astype("<i8"), "radii": np.concatenate(radii).astype("<f8"),
                  "ids": np.asarray(t.column("vec_id")).astype("<i8"), "labels": np.asarray(t.column("label")).astype("<i8"),
                  "vectors": int_matrix(t.column("q")).astype("<i8")}
        return pa.table({"shard": t.column("shard")[:1].cast(pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in values.items()})

    def score(self, rows: np.ndarray, a: np.ndarray, a_fast: np.ndarray | None) -> np.ndarray:
        return (self.fast[rows] @ a_fast).astype(np.int64) if a_fast is not None else products(self.x[rows], a)

    def visit(self, anchor_id: int, label: int, a: np.ndarray, halves: list[np.ndarray], same: bool, windows: Windows) -> None:
        """Walk the cells by the sum of their half bounds until the windows are certified."""
        a_fast = a.astype(np.float64) if self.fast is not None and self.most * float(np.abs(a.astype(np.float64)).max(initial=0)) < 2**53 else None
        order = [p[np.argsort(-h[p], kind="stable")] for p, h in zip(self.present, halves)]
        first, second = (h[o].tolist() for h, o in zip(halves, order))
        left, right = (o.tolist() for o in order)
        heap, held, size = [(-(first[0] + second[0]), 0, 0)], [], 0
        while heap and -heap[0][0] >= windows.floor:
            bound, i, j = heapq.heappop(heap)
            n = self.slot.get(left[i] * self.books.width + right[j])
            if n is not None:
                held.append(np.arange(self.starts[n], self.starts[n + 1]))
                size += len(held[-1])
            # every pair (i, j) is reached once: along its row, rows from their first column
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if not j and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            if size >= BATCH or held and (not heap or -heap[0][0] < windows.floor):
                rows = np.concatenate(held)
                held, size = [], 0
                rows = rows[(self.labels[rows] == label) == same]
                if same:
                    own = np.flatnonzero(self.ids[rows] == anchor_id)
                    if len(own):
                        rows = np.delete(rows, own[(self.x[rows[own]] == a).all(axis=1)])
                if len(rows):
                    windows.add(self.ids[rows], self.score(rows, a, a_fast))
        if held:
            raise AssertionError("rows left unscored")


class Index:
    """The sharded rows, the codebooks, and what the driver knows of each cell."""

    def __init__(self, rows: DataFrame, sample: np.ndarray, centroids: int, shard_rows: int, seed: int):
        books = self.books = Halves(sample, centroids, seed)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, far = books.cells(int_matrix(b.column("q")))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *map(pa.array, far), *(b.column(c) for c in ("vec_id", "label", "q"))],
                                                     names=["cell", "far1", "far2", "vec_id", "label", "q"])

        entries = cut(rows.select("vec_id", "label", "q").mapInArrow(assign, "cell int, far1 double, far2 double, vec_id long, label long, q array<long>"))
        cells = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).orderBy("cell").collect()  # at most centroids ** 2
        self.radii = [np.zeros(len(b)) for b in books.books]
        for c in cells:
            i, j = divmod(c.cell, books.width)
            self.radii[0][i], self.radii[1][j] = max(self.radii[0][i], c.far1), max(self.radii[1][j], c.far2)
        dealt = deal_cells([(c.cell, c.n) for c in cells], shard_rows)
        self.dealt = dealt
        where = rows.sparkSession.createDataFrame([d[:3] for d in dealt], "cell int, first int, parts int")
        shard = (F.col("first") + F.pmod(F.xxhash64("vec_id", "q"), F.col("parts"))).cast("int").alias("shard")
        pack = lambda t: Shard.pack(t, books)
        self.table = entries.join(F.broadcast(where), "cell").select(shard, "cell", "far1", "far2", "vec_id", "label", "q").groupBy("shard").applyInArrow(pack, Shard.SCHEMA)

    def search(self, anchors: DataFrame, same: bool, k: int, home_rows: int, block_anchors: int) -> DataFrame:
        """(a, key, rank, vec_id, score): the k best rows of every window of the anchors.

        ``anchors``: (a, vec_id, label, q, keys, low, high), the last three arrays of one item for each window;
        ``same``: rows of the anchor's label, or of the others. The certificates' rounds are written to the
        checkpoint folder.
        """
        wide = anchors.withColumn("need", F.col("low"))
        near = cut(self._round(wide, same, k, home_rows, block_anchors, True))
        rank = F.row_number().over(Window.partitionBy("a", "key").orderBy(F.desc("score"), "vec_id"))
        kth = near.withColumn("rank", rank).filter(F.col("rank") == k).select("a", "key", "score")
        kth = kth.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("kth"))  # at most one entry a window
        need = F.transform("keys", lambda w, n: F.greatest(F.element_at("low", n + 1), F.coalesce(F.try_element_at("kth", w), F.lit(LEAST))))
        wide = anchors.join(kth, "a", "left").withColumn("need", need).drop("kth")
        rest = self._round(wide, same, k, home_rows, block_anchors, False)
        return cut(near.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("a", "key", "rank", "vec_id", "score"))

    def _round(self, anchors: DataFrame, same: bool, k: int, home_rows: int, block_anchors: int, home: bool) -> DataFrame:
        books, radii = self.books, self.radii
        cell = np.repeat([d[0] for d in self.dealt], [d[2] for d in self.dealt])
        size = np.repeat([d[3] / d[2] for d in self.dealt], [d[2] for d in self.dealt])
        shard = np.concatenate([np.arange(d[1], d[1] + d[2]) for d in self.dealt])
        begin = np.flatnonzero(np.diff(shard, prepend=-1))
        size = np.add.reduceat(size, begin)

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, block_anchors):
                    b = whole.slice(at, block_anchors)
                    q = int_matrix(b.column("q"))
                    half = books.bounds(q, radii)
                    bound = np.maximum.reduceat(half[0][:, cell // books.width] + half[1][:, cell % books.width], begin, axis=1)
                    best = np.argsort(-bound, axis=1, kind="stable")
                    ahead = np.cumsum(size[best], axis=1) - size[best]
                    near = np.zeros(bound.shape, bool)
                    np.put_along_axis(near, best, ahead < home_rows, axis=1)
                    need = np.array([min(w, default=MOST) for w in b.column("need").to_pylist()], dtype=np.float64)
                    visit = (near if home else ~near) & (bound >= need[:, None])
                    for s in np.flatnonzero(visit.any(axis=0)).tolist():
                        yield pa.RecordBatch.from_pylist([{"shard": s} | _binaries(b.take(pa.array(np.flatnonzero(visit[:, s]))))], schema=BLOCK_SCHEMA)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n in range(b.num_rows):
                    row = b.slice(n, 1).to_pylist()[0]
                    found = _visit_block(Shard(row, books), row, same, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["a", "key", "vec_id", "score"])
            give_back()

        return anchors.mapInArrow(plan, BLOCK).join(self.table, "shard").mapInArrow(visit, FOUND)


BLOCK = "shard int, a binary, vec_id binary, label binary, q binary, windows binary, keys binary, low binary, high binary, need binary"
BLOCK_SCHEMA = pa.schema([pa.field(c.split()[0], pa.int32() if "int" in c else pa.binary()) for c in BLOCK.split(", ")])


def _binaries(b: pa.RecordBatch) -> dict[str, bytes]:
    """A block of anchors: one array of longs for each column; windows: how many each anchor has."""
    out = {c: np.asarray(b.column(c)).astype("<i8").tobytes() for c in ("a", "vec_id", "label")}
    out["q"] = int_matrix(b.column("q")).astype("<i8").tobytes()
    lists = {c: b.column(c).to_pylist() for c in ("keys", "low", "high", "need")}
    out["windows"] = np.array([len(x) for x in lists["keys"]], "<i8").tobytes()
    return out | {c: np.array([y for x in v for y in x], "<i8").tobytes() for c, v in lists.items()}


def _visit_block(shard: Shard, row: dict, same: bool, k: int) -> list[np.ndarray]:
    """(a, key, vec_id, score) of what the shard gives to the block's windows."""
    read = {c: np.frombuffer(row[c], "<i8") for c in ("a", "vec_id", "label", "windows", "keys", "low", "high", "need")}
    q = np.frombuffer(row["q"], "<i8").reshape(len(read["a"]), -1)
    halves = shard.books.bounds(q, shard.radii)
    stop = np.cumsum(read["windows"])
    out = []
    for n, (a, z, m) in enumerate(zip(read["a"].tolist(), stop.tolist(), read["windows"].tolist())):
        w = Windows(*(read[c][z - m:z].copy() for c in ("keys", "low", "high", "need")), k)
        shard.visit(int(read["vec_id"][n]), int(read["label"][n]), q[n], [h[n] for h in halves], same, w)
        out += [(np.full(len(i), a), np.full(len(i), key), i, s) for key, i, s in zip(w.keys.tolist(), w.ids, w.scores)]
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def whole_vectors(df: DataFrame, scale: float, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, written to the checkpoint folder: q is floor(scale * x) for each component."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 54)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))
    rows = cut(rows.distinct())
    size = rows.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("q") == size[0].d) if size else rows


def mine(df: DataFrame, is_anchor: Column | str, label: Column | None = None, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (3, 10),
         high: tuple[int, int] = (9, 10), scale: float = 256.0, centroids: int = 32, max_sample: int = 10_000, shard_rows: int = 8_192, home_rows: int = 16_384,
         block_anchors: int = 512, seed: int = 5, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row where ``is_anchor`` holds and each of
    its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high``
    (fractions) of the positive's. ``label``: an expression on (vec_id, label) that replaces the label.
    """
    rows = whole_vectors(df, scale, id_col, label_col, vec_col)
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    share = share_of_draws(max_sample, n)
    drawn = rows if share == DRAWS else rows.filter(draw("vec_id", "q") < share)
    sample = drawn.select("q").toArrow().column("q")
    sample = sample if len(sample) else rows.select("q").limit(1).toArrow().column("q")
    index = Index(rows, int_matrix(sample), centroids, shard_rows, seed)

    anchors = cut(rows.filter(F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor).withColumn("a", F.monotonically_increasing_id()))
    longs = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    first = anchors.select("a", "vec_id", "label", "q", longs(0).alias("keys"), longs(LEAST).alias("low"), longs(MOST).alias("high"))
    best = index.search(first, True, positives, home_rows, block_anchors).select("a", F.col("rank").alias("key"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    of = lambda f: F.col("p.positive_score").cast("decimal(20,0)") * f[0] / f[1]
    window = F.struct(F.col("p.key").cast("long").alias("keys"), F.ceil(of(low)).cast("long").alias("low"), F.floor(of(high)).cast("long").alias("high"))
    ranges = best.alias("p").select("a", window.alias("w")).filter(F.col("w.low") <= F.col("w.high")).groupBy("a").agg(F.sort_array(F.collect_list("w")).alias("w"))  # at most ``positives`` each
    second = anchors.join(ranges, "a").select("a", "vec_id", "label", "q", "w.keys", "w.low", "w.high")
    hard = index.search(second, False, negatives, home_rows, block_anchors)
    named = hard.join(best, ["a", "key"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
