"""Customer segmentation M1–M16 with pyspark.ml k-means.

Grain: one row per customer by default (the ``Unknown`` bucket left out, as
one pseudo-customer would take a cluster of its own); ``segment_input`` with
line-grain input reproduces the original per-line fit.

Fitting is distributed (k-means|| initialisation and Lloyd iterations run as
Spark jobs; only k centres travel to the driver). The fit input is cut from
its lineage once per call: written with ``checkpoint()`` to the session's
``spark.checkpoint.dir`` (shared storage on a cluster), so 2×8 fit/evaluate
passes do not re-run the cleaning and RFM plan, and a lost executor costs a
re-read, not a replay. Its number of partitions follows from its rows, not from the
session, as a pyspark.ml fit depends on it; Spark deletes the files with their frame
where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. ``exact_kmeans`` has
fits that depend on the rows alone.

Cluster ids from k-means are arbitrary (they change with partitioning); they
are renumbered by the centres' profile and labelled by profile, not by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import cluster_display_name, exact_mean
from tillroll.operators.exact_kmeans import SCALED_COLUMNS, deviations, nearest, quantile_starts, scale, scaled_rows
from tillroll.operators.median import exact_median
from tillroll.schemas import (KMEANS_BEST_K, KMEANS_K_RANGE, KMEANS_SEED, RFM_COLUMNS,
                              SEGMENT_LABELS, UNKNOWN_CUSTOMER)
from tillroll.session import written

FEATURES = "features"
SCALED = "scaled_features"
CLUSTER = "cluster"


# --- input, assembling, scaling ----------------------------------------------


def segment_input(df: DataFrame, include_unknown: bool = False) -> DataFrame:
    """M1: CustomerID, Recency, Frequency, Monetary of the rows given (the
    assembler turns them into doubles; sums over clusters stay exact)."""
    out = df.select("CustomerID", *RFM_COLUMNS)
    if not include_unknown:
        out = out.filter(F.col("CustomerID") != UNKNOWN_CUSTOMER)
    return out


def assembler(cols: Sequence[str] = RFM_COLUMNS) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES)


def scaler() -> StandardScaler:
    """Divide by the sample standard deviation, no centring."""
    return StandardScaler(inputCol=FEATURES, outputCol=SCALED, withStd=True, withMean=False)


def assemble_features(df: DataFrame) -> DataFrame:
    """M2: the three metrics as one vector column."""
    return assembler().transform(df)


def scale_features(df: DataFrame) -> DataFrame:
    """M3: fit the scaler (one aggregation job) and add the scaled vector."""
    assembled = assemble_features(df)
    return scaler().fit(assembled).transform(assembled)


def scaled_columns(scaled: DataFrame, digits: int = 9) -> DataFrame:
    """The scaled vector as plain columns ``<metric>_scaled`` (rounded for display)."""
    arr = vector_to_array(F.col(SCALED))
    return scaled.select("CustomerID", *[F.round(arr[i], digits).alias(f"{c}_scaled")
                                         for i, c in enumerate(RFM_COLUMNS)])


def sql_scaled_columns(df: DataFrame) -> DataFrame:
    """Adds x / stddev_samp(x) per metric, to nine decimals, from exact sums (the same
    numbers as the StandardScaler, in a form SQL engines can check).

    The three deviations come from one aggregation job and enter the plan as
    literals, as the scaler's own statistics do: referenced from several
    expressions, a scalar subquery would be copied into each of them.
    """
    return scale(df, deviations(df))


# --- stable fit input ----------------------------------------------------------


#: Fewest partitions of a pyspark.ml fit, and the rows that one of them holds beyond.
FIT_PARTITIONS = 16
FIT_ROWS = 500_000


def stable_input(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fixed partitioning and row order (pyspark.ml fits depend on both), written to the
    checkpoint folder. Without a number of partitions it follows from the number of rows
    alone: the same rows give the same fit in any session, and a task holds a bounded
    share of them. Fits with exact sums (``exact_kmeans``) need none of this."""
    if partitions is None:
        partitions = max(FIT_PARTITIONS, -(-df.count() // FIT_ROWS))
    return written(df.repartition(partitions, "CustomerID").sortWithinPartitions("CustomerID"))


# --- fit, sweep, evaluate -------------------------------------------------------


def kmeans(k: int, seed: int = KMEANS_SEED) -> KMeans:
    return KMeans(featuresCol=SCALED, predictionCol=CLUSTER, k=k, seed=seed)


def evaluator() -> ClusteringEvaluator:
    """M5: squared-Euclidean silhouette."""
    return ClusteringEvaluator(featuresCol=SCALED, predictionCol=CLUSTER, metricName="silhouette")


def silhouette(clustered: DataFrame) -> float:
    return evaluator().evaluate(clustered)


def kmeans_sweep(df: DataFrame, ks: Sequence[int] = KMEANS_K_RANGE, seed: int = KMEANS_SEED,
                 partitions: int | None = None) -> DataFrame:
    """M4: fit k-means for each k over one stable scaled input; (k, silhouette)."""
    spark = df.sparkSession
    # written with its vectors: every fit and every evaluation reads the rows several times
    scaled = written(scale_features(stable_input(df, partitions)))
    rows = []
    for k in ks:
        model = kmeans(k, seed).fit(scaled)
        rows.append((int(k), float(silhouette(model.transform(scaled)))))
    # one row per k tried: a result as small as the parameter list
    return spark.createDataFrame(rows, "k int, silhouette double")


def pick_k(sweep: DataFrame) -> DataFrame:
    """M6: the k with the best silhouette (smallest k on a tie)."""
    return sweep.orderBy(F.col("silhouette").desc(), F.col("k").asc()).limit(1)


@dataclass
class Segmentation:
    """A fitted assembler + scaler + k-means pipeline with profile-ordered ids."""

    model: PipelineModel
    renumber: dict[int, int]          # k-means id -> profile-ordered id
    centers: list[tuple[float, ...]]  # scaled centres, indexed by the new id
    input: DataFrame | None = None    # the stable rows it was fitted on

    @property
    def k(self) -> int:
        return len(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        lookup = F.create_map(*[x for old, new in self.renumber.items() for x in (F.lit(old), F.lit(new))])
        return out.withColumn(CLUSTER, lookup[F.col(CLUSTER)])


def _profile_order(centers: Sequence[Sequence[float]]) -> dict[int, int]:
    """New ids: ascending Recency centre, then descending Monetary centre."""
    order = sorted(range(len(centers)), key=lambda i: (centers[i][0], -centers[i][2], i))
    return {old: new for new, old in enumerate(order)}


def fit_segments(df: DataFrame, k: int = KMEANS_BEST_K, seed: int = KMEANS_SEED,
                 partitions: int | None = None) -> Segmentation:
    """M7: fit assembler + scaler + k-means together (one saveable pipeline).

    The input is made stable first (see ``stable_input``) and kept on the
    result as ``seg.input``, so assigning the fitted rows reads it back
    instead of re-running its plan.
    """
    stable = stable_input(df, partitions)
    model = Pipeline(stages=[assembler(), scaler(), kmeans(k, seed)]).fit(stable)
    return _segmentation(model, stable)


def _segmentation(model: PipelineModel, stable: DataFrame | None) -> Segmentation:
    raw_centers = [tuple(float(v) for v in c) for c in model.stages[-1].clusterCenters()]
    renumber = _profile_order(raw_centers)
    centers = [raw_centers[old] for old, _ in sorted(renumber.items(), key=lambda kv: kv[1])]
    return Segmentation(model, renumber, centers, stable)


def kmeans_segments(seg: Segmentation, df: DataFrame | None = None) -> DataFrame:
    """M7 assignment: CustomerID, R, F, M, cluster (profile-ordered id) of
    ``df``, by default the rows the model was fitted on."""
    rows = df if df is not None else seg.input
    return seg.transform(rows).select("CustomerID", *RFM_COLUMNS, CLUSTER)


def save_segment_model(seg: Segmentation, path: str) -> None:
    """Persist the whole pipeline (assembler, scaler, k-means)."""
    seg.model.write().overwrite().save(path)


def load_segment_model(path: str) -> Segmentation:
    return _segmentation(PipelineModel.load(path), None)


# --- M8: assignment to given centres as an expression -------------------------------


def assign_nearest(df: DataFrame, centers: Sequence[Sequence[Column | float]],
                   cols: Sequence[str] = SCALED_COLUMNS) -> DataFrame:
    """Nearest centre by squared Euclidean distance (first centre on a tie),
    as one built-in expression per row: no join, no Python."""
    return df.withColumn(CLUSTER, nearest(centers, cols))


def segment_assign_fixed(segment_in: DataFrame, k: int = KMEANS_BEST_K) -> DataFrame:
    """M8: scaled metrics assigned to the nearest of k quantile centres."""
    return assign_fixed(segment_in, k)[0]


def assign_fixed(segment_in: DataFrame, k: int = KMEANS_BEST_K) -> tuple[DataFrame, list[list[float]]]:
    """M8 with its centres: centre j sits at the (2j+1)/(2k) exact quantile of every scaled metric."""
    scaled, _ = scaled_rows(segment_in)
    centers = quantile_starts(scaled, [k])[k]
    assigned = assign_nearest(scaled, centers)
    return assigned.select("CustomerID", *RFM_COLUMNS, *SCALED_COLUMNS, CLUSTER), centers


# --- reports over an assignment -----------------------------------------------------


def segment_sizes(clustered: DataFrame) -> DataFrame:
    """M9: rows per cluster (one aggregation, not one job per cluster)."""
    return clustered.groupBy(CLUSTER).agg(F.count(F.lit(1)).alias("count")).orderBy(CLUSTER)


def segment_stats(clustered: DataFrame) -> DataFrame:
    """Min, mean, exact median, max of R, F, M per cluster."""
    simple = clustered.groupBy(CLUSTER).agg(*[
        e for c in RFM_COLUMNS for e in (
            F.min(c).alias(f"{c}_min"),
            exact_mean(c).alias(f"{c}_mean"),
            F.max(c).alias(f"{c}_max"))])
    long = clustered.select(CLUSTER, *[F.col(c).cast("double").alias(c) for c in RFM_COLUMNS]) \
        .unpivot(CLUSTER, list(RFM_COLUMNS), "_metric", "_value")
    med = exact_median(long, [CLUSTER, "_metric"], "_value", "_median")
    medians = med.groupBy(CLUSTER).pivot("_metric", list(RFM_COLUMNS)).agg(F.first("_median"))
    medians = medians.select(CLUSTER, *[F.col(c).alias(f"{c}_median") for c in RFM_COLUMNS])
    cols = [CLUSTER] + [f"{c}_{s}" for c in RFM_COLUMNS for s in ("min", "mean", "median", "max")]
    return simple.join(medians, CLUSTER).select(*cols).orderBy(CLUSTER)


def centers_frame(centers: Sequence[Sequence[float]], spark: SparkSession) -> DataFrame:
    """Centre coordinates in scaled units, one row per cluster (k rows)."""
    rows = [(i, *c) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{c}_center double" for c in RFM_COLUMNS))


def segment_centers(seg: Segmentation, spark: SparkSession) -> DataFrame:
    """The fitted centres."""
    return centers_frame(seg.centers, spark)


def segment_cards(stats: DataFrame, centers: DataFrame) -> DataFrame:
    """One row per cluster × metric: Min, Mean, Median, Max, Center (doubles)."""
    cards = F.array(*[F.struct(F.lit(i).alias("_order"), F.lit(c).alias("Metric"),
                               *[F.col(f"{c}_{s}").cast("double").alias(n) for s, n in (
                                   ("min", "Min"), ("mean", "Mean"), ("median", "Median"), ("max", "Max"), ("center", "Center"))])
                      for i, c in enumerate(RFM_COLUMNS)])
    return (stats.join(F.broadcast(centers), CLUSTER).select(CLUSTER, F.inline(cards))  # k rows
            .orderBy(CLUSTER, "_order").drop("_order"))


def segment_labels(seg: Segmentation, spark: SparkSession) -> DataFrame:
    """Business label per cluster of a fit."""
    return label_centers(seg.centers, spark)


def label_centers(centers: Sequence[Sequence[float]], spark: SparkSession) -> DataFrame:
    """M13 by the centres' profile: highest Monetary centre = Ultra VIP; of the
    rest, highest Recency centre = Churned Low-Value; others = Active Medium-Value."""
    (active, active_t), (vip, vip_t), (churned, churned_t) = SEGMENT_LABELS
    ids = list(range(len(centers)))
    vip_id = max(ids, key=lambda i: (centers[i][2], -i))
    rest = [i for i in ids if i != vip_id]
    churned_id = max(rest, key=lambda i: (centers[i][0], -i)) if rest else None
    rows = [(i, vip, vip_t) if i == vip_id else (i, churned, churned_t) if i == churned_id else (i, active, active_t) for i in ids]
    return spark.createDataFrame(rows, "cluster int, Label string, Key_Traits string").orderBy(CLUSTER)


def fit_check(seg: Segmentation) -> DataFrame:
    """One row for a fit: customers, clusters, and customers that are not at a nearest centre (0)."""
    x = vector_to_array(F.col(SCALED))
    d = [sum((x[j] - F.lit(v)) * (x[j] - F.lit(v)) for j, v in enumerate(c)) for c in seg.centers]
    own = F.element_at(F.array(*d), F.col(CLUSTER) + 1)
    return seg.transform(seg.input).agg(F.count(F.lit(1)).alias("customers"), F.count_distinct(CLUSTER).alias("clusters"),
                                        F.count_if(own > F.least(*d) * (1 + 1e-9) + 1e-12).alias("not_nearest"))


def kmeans_by_lines(weighted: DataFrame, k: int = KMEANS_BEST_K, seed: int = KMEANS_SEED, partitions: int | None = None) -> DataFrame:
    """M7 as first written, at line grain with ``Unknown``: one row per customer,
    fitted with its ``Lines`` as weight instead of that many equal rows."""
    rows = stable_input(weighted.select("CustomerID", *RFM_COLUMNS, "Lines"), partitions)
    sd = deviations(rows, RFM_COLUMNS, "Lines")
    scaled = rows.select("*", array_to_vector(F.array(*[F.col(c).cast("double") / F.lit(sd[c] or 1.0) for c in RFM_COLUMNS])).alias(SCALED))
    model = kmeans(k, seed).setWeightCol("Lines").fit(scaled)
    order = _profile_order([tuple(map(float, c)) for c in model.clusterCenters()])
    lookup = F.create_map(*[x for old, new in order.items() for x in (F.lit(old), F.lit(new))])
    return model.transform(scaled).select("CustomerID", *RFM_COLUMNS, "Lines", lookup[F.col(CLUSTER)].alias(CLUSTER))


def segment_totals_by_lines(clustered: DataFrame) -> DataFrame:
    """M9 and M14 at line grain: lines, Σ R, Σ F, Σ M over lines per cluster."""
    times = F.col("Lines").cast("decimal(13,0)")
    return clustered.groupBy(CLUSTER).agg(F.sum("Lines").alias("count"), *[
        F.sum(F.col(c).cast("decimal(24,3)") * times).cast("decimal(38,3)").alias(f"total_{c}") for c in RFM_COLUMNS]).orderBy(CLUSTER)


def segment_totals(clustered: DataFrame) -> DataFrame:
    """Rows, Σ R, Σ F, Σ M per cluster and each one's share in % (the
    shares' window runs over the k aggregated rows only)."""
    agg = clustered.groupBy(CLUSTER).agg(
        F.count(F.lit(1)).alias("CustomerCount"),
        F.sum("Recency").alias("days_since_last_purchase"),
        F.sum("Frequency").alias("total_purchases"),
        F.sum("Monetary").alias("total_sales"))
    everything = Window.partitionBy()
    out = agg
    for c in ("CustomerCount", "days_since_last_purchase", "total_purchases", "total_sales"):
        out = out.withColumn(f"{c}_pct", F.round(F.try_divide(F.col(c).cast("double") * 100.0,
                                                              F.sum(c).over(everything).cast("double")), 6))
    return out.orderBy(CLUSTER)


def segmented_customers(clustered: DataFrame) -> DataFrame:
    """Distinct rows without the vector columns."""
    drop = [c for c in (FEATURES, SCALED) if c in clustered.columns]
    return clustered.drop(*drop).distinct()


def with_display_name(df: DataFrame, base: int = 0) -> DataFrame:
    """Add ``ClusterLabel`` = 'Cluster i'."""
    return df.withColumn("ClusterLabel", cluster_display_name(CLUSTER, base))
