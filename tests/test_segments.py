import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import segments as S


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(5)
    rows = []
    centres = [(10, 2, 100.0), (200, 1, 50.0), (5, 60, 90000.0)]
    for b, (r, f, m) in enumerate(centres):
        for i in range(10):
            rows.append((f"c{b}_{i}", int(r + rnd.randint(-2, 2)), int(f + rnd.randint(0, 1)),
                         float(m * (1 + rnd.uniform(-0.02, 0.02)))))
    return spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency long, Monetary double")


def test_segments_invariants(spark, blobs):
    seg = S.fit_segments(blobs, k=3, partitions=4)
    clustered = S.kmeans_segments(seg)
    sizes = {r.cluster: r["count"] for r in S.segment_sizes(clustered).collect()}
    assert sum(sizes.values()) == blobs.count() and sorted(sizes.values()) == [10, 10, 10]
    # every point sits at its nearest centre
    scaled = seg.transform(seg.input).select("CustomerID", "cluster", F.col(S.SCALED))
    for r in scaled.collect():
        x = r[S.SCALED].toArray()
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in seg.centers]
        assert d[r.cluster] == min(d)
    sil = S.silhouette(seg.transform(seg.input))
    assert -1.0 <= sil <= 1.0 and sil > 0.8
    labels = {r.cluster: r.Label for r in S.segment_labels(seg, spark).collect()}
    vip = max(range(3), key=lambda i: seg.centers[i][2])
    assert labels[vip] == "Ultra VIP Customer"
    churned = max((i for i in range(3) if i != vip), key=lambda i: seg.centers[i][0])
    assert labels[churned] == "Churned Low-Value Customers"


def test_ids_follow_profile_not_partitioning(spark, blobs):
    def members(parts):
        seg = S.fit_segments(blobs, k=3, partitions=parts)
        out = {}
        for r in S.kmeans_segments(seg).collect():
            out.setdefault(r.cluster, set()).add(r.CustomerID)
        return out

    assert members(1) == members(4) == members(7)


def test_sweep_pick_k_is_argmax(spark, blobs):
    sweep = S.kmeans_sweep(blobs, ks=(2, 3, 4), partitions=2)
    rows = sweep.collect()
    best = S.pick_k(sweep).first()
    assert best.silhouette == max(r.silhouette for r in rows)
    assert best.k == 3


def test_save_load_gives_equal_assignments(spark, blobs, scratch):
    seg = S.fit_segments(blobs, k=3, partitions=2)
    S.save_segment_model(seg, f"{scratch}/model")
    loaded = S.load_segment_model(f"{scratch}/model")
    a = sorted((r.CustomerID, r.cluster) for r in S.kmeans_segments(seg, blobs).collect())
    b = sorted((r.CustomerID, r.cluster) for r in S.kmeans_segments(loaded, blobs).collect())
    assert a == b


def test_reports_shapes(spark, blobs):
    seg = S.fit_segments(blobs, k=3, partitions=2)
    clustered = S.kmeans_segments(seg)
    stats = S.segment_stats(clustered)
    cards = S.segment_cards(stats, S.segment_centers(seg, spark))
    assert cards.count() == 9
    totals = S.segment_totals(clustered).collect()
    assert sum(r.CustomerCount for r in totals) == 30
    assert abs(sum(r.CustomerCount_pct for r in totals) - 100.0) < 1e-6
    names = [r.ClusterLabel for r in S.with_display_name(S.segment_sizes(clustered), base=1).collect()]
    assert names == ["Cluster 1", "Cluster 2", "Cluster 3"]
    assert S.segmented_customers(seg.transform(seg.input)).count() == 30


def test_assign_nearest_first_on_tie(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "Recency_scaled double, Frequency_scaled double, Monetary_scaled double")
    got = S.assign_nearest(df, [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]]).first().cluster
    assert got == 0
