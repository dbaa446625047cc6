"""k-means with exact sums: independent of partitions, equal to a plain repetition, to pyspark's silhouette and to its own table."""

import math
import random
import statistics

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tillroll.operators import exact_kmeans as X
from tillroll.operators import segments as S

SCHEMA = "CustomerID string, Recency int, Frequency long, Monetary decimal(38,3), Lines long"


def customers(n=600, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        r, f, m = rnd.choice([(10, 30, 9e5), (200, 2, 900), (90, 8, 2e4), (5, 200, 3e7)])
        out.append((f"c{i}", int(r + rnd.randrange(30)), int(f + rnd.randrange(10)), f"{m * (1 + rnd.random()):.3f}", rnd.randrange(1, 9)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    from decimal import Decimal

    return spark.createDataFrame([(c, r, f, Decimal(m), n) for c, r, f, m, n in customers()], SCHEMA).cache()


@pytest.mark.parametrize("weight", [None, "Lines"])
def test_same_centres_with_16_and_200_partitions(rows, weight):
    fits = [X.fit(rows.repartition(n, F.rand(n)), 3, weight=weight) for n in (1, 16, 200)]
    assert fits[0].centers == fits[1].centers == fits[2].centers
    assert fits[0].deviations == fits[1].deviations == fits[2].deviations
    members = [sorted((r.CustomerID, r.cluster) for r in f.assign().collect()) for f in fits]
    assert members[0] == members[1] == members[2]


def plain_fit(points, k, rounds):
    """The fit in plain Python; ``points``: scaled triples, repeated by weight."""
    starts = []
    for j in range(k):
        rank = max(1, -(-(2 * j + 1) * len(points) // (2 * k)))
        starts.append([sorted(p[c] for p in points)[rank - 1] for c in range(3)])
    centers = starts
    for _ in range(rounds):
        own = {}
        for p in points:
            d = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in centers]
            own.setdefault(d.index(min(d)), []).append(p)
        centers = [[math.fsum(p[c] for p in own[j]) / len(own[j]) for c in range(3)] if j in own else centers[j] for j in range(k)]
    return centers


@pytest.mark.parametrize("weight", [None, "Lines"])
def test_fit_equals_a_plain_repetition(rows, weight):
    data = [(r, f, float(m), n if weight else 1) for _, r, f, m, n in customers()]
    sds = [statistics.stdev([p[c] for p in data for _ in range(p[3])]) for c in range(3)]
    points = [tuple(round(p[c] / sds[c], 9) for c in range(3)) for p in data for _ in range(p[3])]
    fit = X.fit(rows, 3, weight=weight)
    want = sorted(plain_fit(points, 3, X.ROUNDS), key=lambda c: (c[0], -c[2]))
    assert [pytest.approx(c, abs=1e-8) for c in want] == fit.centers
    assert list(fit.deviations.values()) == pytest.approx(sds, rel=1e-12)


def test_deviation_keeps_digits_of_large_sums(spark):
    from decimal import Decimal

    base = Decimal("123456789012.345")
    df = spark.createDataFrame([("a", 1, 1, base, 1), ("b", 1, 1, base + 1, 3), ("c", 1, 1, base + 2, 1)], SCHEMA)
    assert X.deviations(df)["Monetary"] == 1.0 and X.deviations(df)["Recency"] == 0.0
    assert X.deviations(df, ["Monetary"], "Lines")["Monetary"] == pytest.approx(math.sqrt(0.5), rel=1e-15)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_silhouette_equals_the_evaluator(rows, k):
    fit = X.fit(rows, k)
    own = fit.assign().select(array_to_vector(F.array(*X.SCALED_COLUMNS)).alias("features"), "cluster")
    want = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(own)
    assert X.silhouette(fit.scaled, fit.centers) == pytest.approx(want, abs=2e-9)


def test_weighted_silhouette_equals_repeated_rows(rows):
    fit = X.fit(rows, 3, weight="Lines")
    repeated = fit.assign().withColumn("_", F.explode(F.sequence(F.lit(1), F.col("Lines").cast("int"))))
    own = repeated.select(array_to_vector(F.array(*X.SCALED_COLUMNS)).alias("features"), "cluster")
    want = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(own)
    assert X.silhouette(fit.scaled, fit.centers, "Lines") == pytest.approx(want, abs=2e-9)


def test_sweep_equals_single_fits(rows):
    ks = (2, 3, 4)
    got = {r.k: r.silhouette for r in X.sweep(rows, ks).collect()}
    for k in ks:
        fit = X.fit(rows, k)
        assert got[k] == X.silhouette(fit.scaled, fit.centers)
    assert S.pick_k(X.sweep(rows, ks)).first().k == max(ks, key=lambda k: (got[k], -k))


def test_awkward_rows(spark, rows):
    empty = X.fit(rows.limit(0), 3)
    assert empty.assign().count() == 0 and X.silhouette(empty.scaled, empty.centers) is None
    one = spark.createDataFrame([("a", 5, 2, None, 1)], SCHEMA).fillna({"Recency": 5}).withColumn("Monetary", F.lit(3).cast("decimal(38,3)"))
    fit = X.fit(one, 2)
    assert [r.cluster for r in fit.assign().collect()] == [0] and X.silhouette(fit.scaled, fit.centers) is None
    same = spark.createDataFrame([(str(i), 5, 2, None, 1) for i in range(4)], SCHEMA).withColumn("Monetary", F.col("CustomerID").cast("decimal(38,3)"))
    fit = X.fit(same, 2)
    assert fit.deviations["Recency"] == 0.0 and X.silhouette(fit.scaled, fit.centers) is not None
    alone = spark.createDataFrame([("a", 0, 0, None, 1), ("b", 100, 0, None, 1), ("c", 101, 0, None, 1)], SCHEMA).withColumn("Monetary", F.lit(1).cast("decimal(38,3)"))
    scaled, _ = X.scaled_rows(alone)
    sd = X.deviations(alone)["Recency"]
    x, y, z = (round(v / sd, 9) for v in (0, 100, 101))
    near = 1 - (z - y) ** 2 / (y - x) ** 2, 1 - (z - y) ** 2 / (z - x) ** 2
    assert X.silhouette(scaled, [[0.0, 0.0, 0.0], [y, 0.0, 0.0]]) == pytest.approx(sum(near) / 3, abs=2e-9)


def test_model_table_round_trip(spark, rows, scratch):
    fit = X.fit(rows, 4)
    X.write_model(fit, f"{scratch}/model", spark)
    table = spark.read.parquet(f"{scratch}/model")
    assert table.count() == 12 and set(table.columns) == {"cluster", "position", "metric", "deviation", "center"}
    read = X.read_model(spark, f"{scratch}/model")
    assert (read.centers, read.deviations) == (fit.centers, fit.deviations)
    own = sorted((r.CustomerID, r.cluster) for r in fit.assign().collect())
    assert own == sorted((r.CustomerID, r.cluster) for r in read.assign(rows).collect())
    joined = X.assign_by_model(rows, table)
    assert own == sorted((r.CustomerID, r.cluster) for r in joined.collect())
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_ml_fit_input_grows_with_the_rows(rows, monkeypatch):
    monkeypatch.setattr(S, "FIT_ROWS", 20)
    assert S.stable_input(rows).rdd.getNumPartitions() == 30
    monkeypatch.undo()
    assert S.stable_input(rows).rdd.getNumPartitions() == S.FIT_PARTITIONS


@pytest.mark.parametrize("weight", [None, "w"])
def test_cluster_sums_are_exact_fractions(spark, weight):
    """Sums and squared norms keep every decimal, beyond what doubles or 38 digits hold; rows that lack a metric are counted apart."""
    from fractions import Fraction

    rnd = random.Random(5)
    points = [(rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randrange(9), round(rnd.random(), 9), float(rnd.randrange(5)), rnd.randrange(1, 10 ** 11)) for _ in range(500)]
    points = [(round(a, 9), b, c, w) for a, b, c, w in points]
    df = spark.createDataFrame([*points, (None, 1.0, 1.0, 7)], "a double, b double, c double, w long").repartition(7)
    centers = {k: [list(p[:3]) for p in points[:k]] for k in (2, 5)}
    got = X._cluster_sums(df, centers, weight, ["a", "b", "c"], norms=True)
    for k, cs in centers.items():
        want = {}
        for *p, w in points:
            d = [(p[0] - c[0]) * (p[0] - c[0]) + (p[1] - c[1]) * (p[1] - c[1]) + (p[2] - c[2]) * (p[2] - c[2]) for c in cs]
            x, n = [Fraction(repr(v)) for v in p], w if weight else 1
            x = [round(v * 10 ** 9) / Fraction(10 ** 9) for v in x]
            old = want.setdefault(d.index(min(d)), [0] * 5)
            want[d.index(min(d))] = [s + n * t for s, t in zip(old, (1, *x, sum(v * v for v in x)))]
        assert {j: list(v) for (kk, j), v in got.items() if kk == k and j is not None} == want
        assert got[k, None][0] == (7 if weight else 1)


def test_row_silhouettes_over_arrays():
    import numpy as np

    xs = [np.array([0.0, 1.0, 10.0, 11.0, 30.0])]
    own = X._nearest(xs, [[0.5], [10.5], [30.0]])
    assert own.tolist() == [0, 0, 1, 1, 2]
    clusters = [([0.5], 0.5, 2.0), ([10.5], 110.5, 2.0), ([30.0], 900.0, None)]
    want = [1 - 1 / 110.5, 1 - 1 / 90.5, 1 - 1 / 90.5, 1 - 1 / 110.5, 0]
    assert X._row_silhouettes(xs, own, clusters).tolist() == pytest.approx([w * 1e12 for w in want], abs=100)


def test_quantiles_of_one_range_are_binned_once(rows, monkeypatch):
    """Thirty quantiles put a row into one bin, not into thirty, while they share a range."""
    from tillroll.operators import quantiles as Q

    monkeypatch.setattr(Q.F, "array", lambda *c, array=F.array: widths.append(len(c)) or array(*c))
    widths, qs = [], [i / 31 for i in range(1, 31)]
    want = sorted(r.Lines for r in rows.select("Lines").collect())
    got = Q.exact_quantiles(rows, "Lines", qs)
    assert widths == [1] and got == [want[max(1, math.ceil(q * len(want))) - 1] for q in qs]
    for longs in (1 << 62, 1):  # as 64-bit integers and as decimals
        monkeypatch.setattr(Q, "LONGS", longs)
        assert Q.exact_quantiles(rows, "Recency", [0.25, 0.5]) == [sorted(r.Recency for r in rows.select("Recency").collect())[n - 1] for n in (150, 300)]
