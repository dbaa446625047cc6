"""Segmentation queries over the test tables.

k-means entries (rows-only checks: the fit depends on initialisation) and the
``*_fixed`` entries: the same reports over the SQL-checkable assignment to k
quantile centres (M8). ``*_exact`` entries: k-means with order-independent sums,
which SQL repeats round by round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import exact_kmeans as X
from tillroll.operators import profile as P
from tillroll.operators import segments as S
from tillroll.plans.prepared import RetailTables
from tillroll.schemas import KMEANS_BEST_K, KMEANS_K_RANGE, RFM_COLUMNS
from tillroll.session import ensure_checkpoint_dir, written

Query = Callable[[SparkSession, str], DataFrame]


def _input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer grain, without the Unknown bucket."""
    return S.segment_input(RetailTables.from_testdata(spark, sf_dir).rfm(), include_unknown=False)


def _input_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line grain (RFM joined to lines), Unknown included."""
    return S.segment_input(RetailTables.from_testdata(spark, sf_dir).final_v3, include_unknown=True)


def _fitted(spark: SparkSession, sf_dir: str) -> S.Segmentation:
    return S.fit_segments(_input(spark, sf_dir), KMEANS_BEST_K)


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kmeans_segments(_fitted(spark, sf_dir))


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_assign_fixed(_input(spark, sf_dir), KMEANS_BEST_K)


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.assemble_features(_input(spark, sf_dir))
    return a.select("CustomerID", vector_to_array(F.col(S.FEATURES)).alias("features"))


def _silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _fitted(spark, sf_dir)
    score = S.silhouette(seg.transform(seg.input))
    return spark.createDataFrame([(seg.k, float(score))], "k int, silhouette double")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _fitted(spark, sf_dir)
    return S.segment_cards(S.segment_stats(S.kmeans_segments(seg)), S.segment_centers(seg, spark))


def _cards_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centers = S.assign_fixed(_input(spark, sf_dir), KMEANS_BEST_K)
    return S.segment_cards(S.segment_stats(assigned), S.centers_frame(centers, spark))


def _labels_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_centers(S.assign_fixed(_input(spark, sf_dir), KMEANS_BEST_K)[1], spark)


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _fitted(spark, sf_dir)
    return S.segmented_customers(seg.transform(seg.input))


def _sweep_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many k were tried, whether the picked k has the best silhouette, whether all lie in [-1, 1]."""
    sweep = S.kmeans_sweep(_input(spark, sf_dir))
    best = S.pick_k(sweep).select("silhouette").scalar()
    return sweep.agg(F.count(F.lit(1)).alias("ks"), F.bool_and(F.col("silhouette") <= best).alias("best_is_highest"),
                     F.bool_and(F.col("silhouette").between(-1, 1)).alias("in_range"))


def _by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kmeans_by_lines(RetailTables.from_testdata(spark, sf_dir).weighted())


def _exact(spark: SparkSession, sf_dir: str) -> X.ExactFit:
    return X.fit(_input(spark, sf_dir), KMEANS_BEST_K)


def _exact_rows(fitted: X.ExactFit) -> DataFrame:
    return fitted.assign().select("CustomerID", *RFM_COLUMNS, S.CLUSTER)


def _exact_centers(fitted: X.ExactFit, spark: SparkSession) -> DataFrame:
    return S.centers_frame([[round(v, X.DIGITS) for v in c] for c in fitted.centers], spark)


def _exact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _exact(spark, sf_dir)
    return S.segment_cards(S.segment_stats(_exact_rows(fitted)), _exact_centers(fitted, spark))


def _exact_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = X.fit(RetailTables.from_testdata(spark, sf_dir).weighted().select("CustomerID", *RFM_COLUMNS, "Lines"), KMEANS_BEST_K, weight="Lines")
    return fitted.assign().select("CustomerID", *RFM_COLUMNS, "Lines", S.CLUSTER)


def _silhouette_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centers = S.assign_fixed(_input(spark, sf_dir), KMEANS_BEST_K)
    return spark.createDataFrame([(len(centers), X.silhouette(assigned, centers))], "k int, silhouette double")


def _silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _exact(spark, sf_dir)
    return spark.createDataFrame([(len(fitted.centers), X.silhouette(fitted.scaled, fitted.centers))], "k int, silhouette double")


def _model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit's model written as a table and read back twice, on the driver and inside a plan: customers
    that either assigns elsewhere than the fit itself (0), of all customers."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    customers = written(_input(spark, sf_dir))
    fitted = X.fit(customers, KMEANS_BEST_K)
    X.write_model(fitted, path, spark)
    own = fitted.assign().select("CustomerID", F.col(S.CLUSTER).alias("own"))
    read = X.read_model(spark, path).assign(customers).select("CustomerID", F.col(S.CLUSTER).alias("read"))
    joined = X.assign_by_model(customers, spark.read.parquet(path)).select("CustomerID", F.col(S.CLUSTER).alias("joined"))
    return own.join(read, "CustomerID", "full").join(joined, "CustomerID", "full").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(~(F.col("own").eqNullSafe(F.col("read")) & F.col("own").eqNullSafe(F.col("joined")))).alias("differing"))


def _assembled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 with the vector's entries as columns."""
    return _assembled(spark, sf_dir).select("CustomerID", *[F.col("features")[i].alias(f"{c}_feature") for i, c in enumerate(RFM_COLUMNS)])


SEGMENTS: dict[str, Query] = {
    "assemble_features_columns": _assembled_columns,
    "silhouette_fixed": _silhouette_fixed,
    "silhouette_exact": _silhouette_exact,
    "kmeans_sweep_exact": lambda s, d: X.sweep(_input(s, d), KMEANS_K_RANGE),
    "pick_k_exact": lambda s, d: S.pick_k(X.sweep(_input(s, d), KMEANS_K_RANGE)),
    "kmeans_segments_exact": lambda s, d: _exact_rows(_exact(s, d)),
    "kmeans_segments_exact_as_written": _exact_by_lines,
    "segment_centers_exact": lambda s, d: _exact_centers(_exact(s, d), s),
    "segment_sizes_exact": lambda s, d: S.segment_sizes(_exact_rows(_exact(s, d))),
    "segment_cards_exact": _exact_cards,
    "segment_labels_exact": lambda s, d: S.label_centers(_exact(s, d).centers, s),
    "segment_totals_exact": lambda s, d: S.segment_totals(_exact_rows(_exact(s, d))),
    "segment_model_round_trip": _model_round_trip,
    "segment_input": _input,
    "segment_input_as_written": _input_as_written,
    "segment_input_count": lambda s, d: P.row_count(_input(s, d)),
    "segment_input_count_as_written": lambda s, d: P.row_count(_input_as_written(s, d)),
    "assemble_features": _assembled,
    "scale_features": lambda s, d: S.scaled_columns(S.scale_features(_input(s, d))),
    "kmeans_sweep": lambda s, d: S.kmeans_sweep(_input(s, d)),
    "silhouette": _silhouette,
    "pick_k": lambda s, d: S.pick_k(S.kmeans_sweep(_input(s, d))),
    "kmeans_segments": _clustered,
    "segment_sizes": lambda s, d: S.segment_sizes(_clustered(s, d)),
    "segment_stats": lambda s, d: S.segment_stats(_clustered(s, d)),
    "segment_centers": lambda s, d: S.segment_centers(_fitted(s, d), s),
    "segment_cards": _cards,
    "segment_labels": lambda s, d: S.segment_labels(_fitted(s, d), s),
    "segment_totals": lambda s, d: S.segment_totals(_clustered(s, d)),
    "segmented_customers": _segmented,
    "kmeans_fit_check": lambda s, d: S.fit_check(_fitted(s, d)),
    "kmeans_sweep_check": _sweep_check,
    "kmeans_segments_as_written": _by_lines,
    "segment_totals_as_written": lambda s, d: S.segment_totals_by_lines(_by_lines(s, d)),
    "segment_totals_as_written_check": lambda s, d: S.segment_totals_by_lines(_by_lines(s, d)).agg(
        F.sum("count").alias("lines"), *[F.sum(f"total_{c}").cast("decimal(38,3)").alias(f"total_{c}") for c in ("Recency", "Frequency", "Monetary")]),
    "segment_cards_fixed": _cards_fixed,
    "segment_labels_fixed": _labels_fixed,
    "segmented_customers_fixed": lambda s, d: S.segmented_customers(_fixed(s, d)),
    "segment_assign_fixed": _fixed,
    "segment_sizes_fixed": lambda s, d: S.segment_sizes(_fixed(s, d)),
    "segment_stats_fixed": lambda s, d: S.segment_stats(_fixed(s, d)),
    "segment_totals_fixed": lambda s, d: S.segment_totals(_fixed(s, d)),
    "cluster_display_name": lambda s, d: S.with_display_name(S.segment_sizes(_fixed(s, d))),
}
