"""k-means whose result depends on the rows alone, not on how they are dealt out.

Metrics are scaled by their sample deviation and rounded to nine decimals; from there
on every sum over rows is a sum of decimals, which no order of addition changes. The
deviations come from exact sums too. Start centres are exact quantiles (or given), and
a fixed number of Lloyd's rounds follows, so the same rows give the same centres, bit by
bit, with 16 partitions or 200, and SQL engines can repeat the fit.

Each round is one pass over the written rows for all k at once: tasks assign batches of rows
for every k and sum them as whole numbers, one row a centre leaves a task, and as many
rows as there are centres reach the driver. Rounds stop early where no centre moves.

``weight``: a column of whole numbers; a row then stands for that many equal rows.

Edge cases. A metric that never varies is 0 for all rows. A centre that no row is nearest to
stays where it is. Of equally near centres the first is taken. No rows: no centres move,
deviations are 0 and silhouettes null. Squares beyond 10**32 in total fail rather than round.
A silhouette between two distances of 0 is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.quantiles import exact_quantiles
from tillroll.schemas import RFM_COLUMNS
from tillroll.session import ship_package, written

DIGITS = 9  # decimals of scaled metrics
UNIT = T.DecimalType(18, DIGITS)
SCORE_DIGITS = 12  # decimals of a row's silhouette
WEIGHT = T.DecimalType(12, 0)
ROUNDS = 10
CLUSTER = "cluster"

Centers = list[list[float]]


def scaled_name(metric: str) -> str:
    return f"{metric}_scaled"


SCALED_COLUMNS = tuple(scaled_name(c) for c in RFM_COLUMNS)


def _exact(df: DataFrame, column: str) -> Column:
    """The column as a decimal: whole numbers and decimals as they are, doubles to six decimals."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast(T.DecimalType(19, 0))
    return F.col(column).cast(T.DecimalType(18, min(kind.scale, 6) if isinstance(kind, T.DecimalType) else 6))


def deviations(df: DataFrame, columns: Sequence[str] = RFM_COLUMNS, weight: str | None = None) -> dict[str, float]:
    """Sample standard deviation of each column (0 for fewer than two rows), rounded once, from exact sums."""
    w = F.col(weight).cast(WEIGHT) if weight else F.lit(1).cast(T.DecimalType(1, 0))
    sums = []
    for c in columns:
        x = _exact(df, c)
        n = F.when(x.isNotNull(), w)
        sums += [F.sum(n).alias(f"{c}_n"), F.sum(x * w).alias(f"{c}_x"), F.sum(x * x * w).alias(f"{c}_xx")]
    row, out = df.agg(*sums).first(), {}
    for c in columns:
        n, x, xx = (Fraction(row[f"{c}_{s}"] or 0) for s in ("n", "x", "xx"))
        out[c] = math.sqrt((n * xx - x * x) / (n * (n - 1))) if n > 1 else 0.0
    return out


def scale(df: DataFrame, sds: Mapping[str, float]) -> DataFrame:
    """Adds x / deviation for each metric, to nine decimals."""
    return df.select("*", *[(F.round(F.col(c).cast("double") / F.lit(sd), DIGITS) if sd else F.lit(0.0)).alias(scaled_name(c)) for c, sd in sds.items()])


def quantile_starts(scaled: DataFrame, ks: Sequence[int], weight: str | None = None, cols: Sequence[str] = SCALED_COLUMNS) -> dict[int, Centers]:
    """For each k its start centres: centre j at the (2j+1)/(2k) exact quantile of every metric."""
    qs = sorted({Fraction(2 * j + 1, 2 * k) for k in ks for j in range(k)})
    at = [dict(zip(qs, exact_quantiles(scaled, c, qs, weight, scale=DIGITS))) for c in cols]
    return {k: [[a[Fraction(2 * j + 1, 2 * k)] or 0.0 for a in at] for j in range(k)] for k in ks}


def nearest(centers: Sequence[Sequence[float | Column]], cols: Sequence[str] = SCALED_COLUMNS) -> Column:
    """Index of the nearest centre by squared distance, as one expression."""
    dists = []
    for c in centers:
        d = None
        for x, v in zip(cols, c):
            diff = F.col(x) - (v if isinstance(v, Column) else F.lit(float(v)))
            d = diff * diff if d is None else d + diff * diff
        dists.append(d)
    arr = F.array(*dists)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


_PIECE = 20  # bits of a piece: sums of products of two pieces over a batch fit 64-bit integers
_LOW = (1 << _PIECE) - 1


def _pieces(whole: np.ndarray) -> list[np.ndarray]:
    """A whole number below 2**60 in pieces, the lowest first: x = sum(piece i << 20 i)."""
    return [whole & _LOW, (whole >> _PIECE) & _LOW, whole >> 2 * _PIECE]


def _narrow(scaled: DataFrame, cols: Sequence[str], weight: str | None) -> DataFrame:
    """Of each row the metrics as doubles (x0, x1, ..), as whole numbers of 10**-9 (u0, u1, ..) and its weight (w)."""
    ship_package(scaled.sparkSession)
    units = [(F.col(c).cast(UNIT) * F.lit(10 ** DIGITS).cast(T.DecimalType(10, 0))).cast("long").alias(f"u{i}") for i, c in enumerate(cols)]
    return scaled.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *units, *([F.col(weight).cast(WEIGHT).cast("long").alias("w")] if weight else []))


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray | None, np.ndarray]:
    """Metrics (null: NaN), units and weights (null: 0) of a batch of ``_narrow``, and which rows have every metric."""
    xs = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
    us = [pc.fill_null(batch.column(width + i), 0).to_numpy(zero_copy_only=False) for i in range(width)]
    w = pc.fill_null(batch.column(2 * width), 0).to_numpy(zero_copy_only=False) if batch.num_columns > 2 * width else None
    return xs, us, w, ~np.isnan(sum(xs))


def _nearest(xs: Sequence[np.ndarray], centers: Centers) -> np.ndarray:
    """``nearest`` over arrays: the same operations in the same order, so the same index."""
    dists = []
    for c in centers:
        d = None
        for x, v in zip(xs, c):
            diff = x - v
            d = diff * diff if d is None else d + diff * diff
        dists.append(d)
    return np.argmin(dists, axis=0)


def _cluster_sums(scaled: DataFrame, centers: Mapping[int, Centers], weight: str | None, cols: Sequence[str], norms: bool = False) -> dict:
    """(k, cluster) -> (rows, sum of each column, sum of squared norms) as exact fractions; rows that lack a metric have cluster None.

    One pass for every k: each task sums its batches as whole numbers and gives one row a
    centre; Spark adds these, and as many rows as there are centres are collected.
    """
    width, ks = len(cols), sorted(centers)
    names = [*(f"s{i}" for i in range(width)), "hi", "lo"]

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            xs, us, w, known = _arrays(b, width)
            weights = [np.ones(len(known), np.int64)] if w is None else _pieces(w)
            pieces = [_pieces(u) for u in us]
            parts = [p * v for ps in pieces for p in ps for v in weights] + weights
            if norms:  # the squares' digits in base 2**20
                square = [sum(c * c for c, _, _ in pieces), sum(2 * m * c for c, m, _ in pieces), sum(2 * h * c + m * m for c, m, h in pieces),
                          sum(2 * h * m for _, m, h in pieces), sum(h * h for _, _, h in pieces)]
                parts += square if w is None else [q.astype(object) * w for q in square]
            for k in ks:
                own = np.where(known, _nearest(xs, centers[k]), -1)
                order = np.argsort(own, kind="stable")
                js, at = np.unique(own[order], return_index=True)
                sums = [np.add.reduceat(p[order], at) for p in parts]
                for i, j in enumerate(js.tolist()):
                    old = total.setdefault((k, j), [0] * len(parts))
                    total[k, j] = [x + int(s[i]) for x, s in zip(old, sums)]
        several = 3 if weight else 1
        rows = []
        for (k, j), t in total.items():
            def whole(digits: Sequence[int]) -> int:
                return sum(d << _PIECE * i for i, d in enumerate(digits))
            metrics = [whole([whole(t[(3 * i + p) * several:(3 * i + p + 1) * several]) for p in range(3)]) for i in range(width)]
            n, square = whole(t[3 * width * several:(3 * width + 1) * several]), whole(t[(3 * width + 1) * several:])
            rows.append((k, j, n, *[str(v) for v in (*metrics, *divmod(square, 10 ** (2 * DIGITS)))]))
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.string()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["k", "j", "n", *names])

    found = (_narrow(scaled, cols, weight).mapInArrow(sums_of, "k int, j int, n long, " + ", ".join(f"{c} string" for c in names)).groupBy("k", "j")
             .agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast(T.DecimalType(38, 0))).alias(c) for c in names]).collect())
    unit = 10 ** DIGITS
    return {(r.k, None if r.j < 0 else r.j): (int(r.n), *[Fraction(int(r[c]), unit) for c in names[:width]], int(r.hi) + Fraction(int(r.lo), unit * unit))
            for r in found if r.n}


def lloyd(scaled: DataFrame, starts: Mapping[int, Centers], rounds: int = ROUNDS, weight: str | None = None, cols: Sequence[str] = SCALED_COLUMNS) -> dict[int, Centers]:
    """The centres of every k after ``rounds`` rounds; one pass over the rows a round."""
    centers, moving = dict(starts), set(starts)
    for _ in range(rounds):
        if not moving:
            break
        sums = _cluster_sums(scaled, {k: centers[k] for k in sorted(moving)}, weight, cols)
        for k in sorted(moving):
            new = [[float(s) / own[0] for s in own[1:-1]] if (own := sums.get((k, j))) else list(old) for j, old in enumerate(centers[k])]
            if new == centers[k]:
                moving = moving - {k}
            centers[k] = new
    return centers


def profile_order(centers: Sequence[Sequence[float]]) -> list[int]:
    """Old ids in the order of the new ones: ascending Recency centre, then descending Monetary centre."""
    return sorted(range(len(centers)), key=lambda i: (centers[i][0], -centers[i][2], i))


@dataclass
class ExactFit:
    """Deviations and profile-ordered centres of a fit, and the scaled rows it was made from."""

    deviations: dict[str, float]
    centers: Centers
    scaled: DataFrame | None = None

    def assign(self, df: DataFrame | None = None) -> DataFrame:
        """Rows (by default those fitted) with scaled metrics and the id of the nearest centre."""
        rows = self.scaled if df is None else scale(df, self.deviations)
        return rows.withColumn(CLUSTER, nearest(self.centers))


def scaled_rows(df: DataFrame, weight: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """The rows with scaled metrics, and the deviations; written once to the checkpoint folder."""
    rows = written(df)
    sds = deviations(rows, RFM_COLUMNS, weight)
    return scale(rows, sds), sds


def fit(df: DataFrame, k: int, rounds: int = ROUNDS, weight: str | None = None) -> ExactFit:
    """M7 / M11 with exact sums: quantile starts, then Lloyd's rounds; ids follow the centres' profile."""
    scaled, sds = scaled_rows(df, weight)
    centers = lloyd(scaled, quantile_starts(scaled, [k], weight), rounds, weight)[k]
    return ExactFit(sds, [centers[i] for i in profile_order(centers)], scaled)


# --- M5: silhouette ------------------------------------------------------------------


def silhouettes(scaled: DataFrame, centers: Mapping[int, Centers], weight: str | None = None, cols: Sequence[str] = SCALED_COLUMNS) -> dict[int, float | None]:
    """Mean squared-Euclidean silhouette of every k, to nine decimals, in two passes over the rows.

    A cluster's count, sum and sum of squared norms give the mean squared distance of any row to
    it, so no pairs of rows are formed. A row alone in its cluster scores 0. With rows in one
    cluster only (or none): None.
    """
    sums, width = _cluster_sums(scaled, centers, weight, cols, norms=True), len(cols)
    total, clusters = sum(v[0] for (k, _), v in sums.items() if k == min(centers, default=0)), {}
    for k, own in centers.items():
        known = [sums.get((k, j)) for j in range(len(own))]
        if sum(bool(v) for v in known) >= 2:  # of every cluster its mean, its mean squared norm and n / (n - 1)
            clusters[k] = [v and ([float(s) / v[0] for s in v[1:-1]], float(v[-1]) / v[0], v[0] / (v[0] - 1.0) if v[0] > 1 else None) for v in known]
    if not clusters:
        return dict.fromkeys(centers)

    def scores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(clusters, 0)
        for b in batches:
            xs, _, w, known = _arrays(b, width)
            xs = [x[known] for x in xs]
            for k, stats in clusters.items():
                units = _row_silhouettes(xs, _nearest(xs, centers[k]), stats)
                found[k] += int(units.sum() if w is None else (units.astype(object) * w[known]).sum())
        rows = [(k, str(v)) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.string()))], names=["k", "score"])

    rows = _narrow(scaled, cols, weight).mapInArrow(scores_of, "k int, score string").groupBy("k").agg(F.sum(F.col("score").cast(T.DecimalType(38, 0))).alias("score")).collect()
    scores = {r.k: int(r.score) / 10 ** SCORE_DIGITS for r in rows}
    return {k: round(scores[k] / float(total), DIGITS) if k in scores else None for k in centers}


def _row_silhouettes(xs: Sequence[np.ndarray], own: np.ndarray, clusters: Sequence) -> np.ndarray:
    """Silhouettes of rows in units of 10**-12; ``clusters``: (mean, mean squared norm, n / (n - 1), None if n is 1), None without rows."""
    norm = None
    for x in xs:
        norm = x * x if norm is None else norm + x * x
    mean = np.full((len(clusters), len(own)), np.inf)
    for j, stats in enumerate(clusters):
        if stats:
            dot = None
            for x, v in zip(xs, stats[0]):
                dot = x * v if dot is None else dot + x * v
            mean[j] = (norm + stats[1]) - 2.0 * dot
    at = np.arange(len(own))
    rest = np.array([stats[2] if stats and stats[2] else np.nan for stats in clusters])[own]
    a = mean[own, at] * rest
    mean[own, at] = np.inf
    b = mean.min(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(a < b, 1.0 - a / b, np.where(a > b, b / a - 1.0, 0.0))
    s = np.where(np.isfinite(s), s, 0.0) * 10 ** SCORE_DIGITS
    return (np.sign(s) * np.floor(np.abs(s) + 0.5)).astype(np.int64)


def silhouette(scaled: DataFrame, centers: Centers, weight: str | None = None) -> float | None:
    return silhouettes(scaled, {len(centers): centers}, weight)[len(centers)]


def sweep(df: DataFrame, ks: Sequence[int], rounds: int = ROUNDS, weight: str | None = None) -> DataFrame:
    """M4: (k, silhouette) of an exact fit for every k, all fitted over the same rows in the same passes."""
    scaled, _ = scaled_rows(df, weight)
    centers = lloyd(scaled, quantile_starts(scaled, ks, weight), rounds, weight)
    scores = silhouettes(scaled, centers, weight)
    return df.sparkSession.createDataFrame([(k, scores[k]) for k in ks], "k int, silhouette double")


# --- S6: the model as a table ----------------------------------------------------------


def model_table(fitted: ExactFit, spark: SparkSession) -> DataFrame:
    """One row for each cluster and metric: what any later job needs to assign customers."""
    rows = [(j, i, m, float(fitted.deviations[m]), float(c[i])) for j, c in enumerate(fitted.centers) for i, m in enumerate(RFM_COLUMNS)]
    return spark.createDataFrame(rows, "cluster int, position int, metric string, deviation double, center double")


def write_model(fitted: ExactFit, path: str, spark: SparkSession) -> None:
    """The model table as Parquet, as one file."""
    model_table(fitted, spark).coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> ExactFit:
    """The fit of ``write_model`` (clusters times metrics rows are read)."""
    rows = sorted((r.cluster, r.position, r.metric, r.deviation, r.center) for r in spark.read.parquet(path).collect())
    centers: Centers = [[] for _ in range(max((r[0] for r in rows), default=-1) + 1)]
    for j, _, _, _, v in rows:
        centers[j].append(v)
    return ExactFit({m: sd for _, _, m, sd, _ in rows}, centers)


def assign_by_model(df: DataFrame, model: DataFrame) -> DataFrame:
    """Customers with the nearest centre of a model table, in one plan: the table enters as a scalar, nothing is collected."""
    packed = model.agg(F.sort_array(F.collect_list(F.struct("cluster", "position", "center", "deviation"))).alias("m"))  # clusters x metrics entries
    width, m = len(RFM_COLUMNS), F.col("_model")
    rows = df.withColumn("_model", packed.scalar())
    rows = rows.select("*", *[F.coalesce(F.round(F.try_divide(F.col(c).cast("double"), m[i]["deviation"]), DIGITS), F.lit(0.0)).alias(scaled_name(c))
                              for i, c in enumerate(RFM_COLUMNS)])

    def distance(j: Column) -> Column:
        d = None
        for i, c in enumerate(SCALED_COLUMNS):
            diff = F.col(c) - F.get(m, j * width + i)["center"]
            d = diff * diff if d is None else d + diff * diff
        return d

    dists = F.transform(F.sequence(F.lit(0), (F.size(m) / width).cast("int") - 1), distance)
    return rows.withColumn(CLUSTER, (F.array_position(dists, F.array_min(dists)) - 1).cast("int")).drop("_model")
