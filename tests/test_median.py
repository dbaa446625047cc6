import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators.median import exact_median


@pytest.mark.parametrize("accuracy", [10000, 20])
def test_exact_median_matches_numpy_with_hot_group_and_ties(spark, accuracy):
    rnd = random.Random(3)
    rows = []
    # group 0 is hot (a third of the rows) and heavily tied; others are small / spread
    rows += [(0, float(rnd.choice([1, 1, 1, 2, 5, 9]))) for _ in range(3000)]
    rows += [(1, rnd.uniform(-5, 5)) for _ in range(3001)]
    rows += [(2, float(rnd.randint(0, 3))) for _ in range(3000)]
    rows += [(3, 7.25)]
    rows += [(4, 1.0), (4, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", accuracy=accuracy).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array(sorted(v for gg, v in rows if gg == g))
        assert got[g] == pytest.approx(float(np.median(vals)), rel=0, abs=1e-12), g


def test_exact_median_equals_spark_percentile(spark):
    rnd = random.Random(11)
    rows = [(i % 3, rnd.randint(0, 40)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    exact = {r.g: r.m for r in df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m")).collect()}
    assert got == exact
