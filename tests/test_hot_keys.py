"""Hot keys are found by their measured number of rows, whoever they are."""

import datetime as dt
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import features as Fe
from tillroll.operators import hot_keys as H
from tillroll.operators.median import exact_median
from tillroll.schemas import FEATURES_IN


@pytest.fixture(scope="module")
def lines(spark):
    """Unknown holds a third of the lines, another customer 30 %, the others little; one customer has no id."""
    rnd = random.Random(1)
    rows = []
    for i in range(4_000):
        who = "Unknown" if i % 3 == 0 else "big" if rnd.random() < 0.45 else f"c{rnd.randrange(300)}"
        rows.append((str(i // 4), f"p{i % 50}", "mug", 1 + i % 7, dt.date(2011, 1, 1 + i % 28), Decimal("1.50"), None if i == 17 else who, "UK"))
    return spark.createDataFrame(rows, FEATURES_IN).cache()


def test_every_hot_customer_is_dealt_out(lines):
    counts = Fe.per_customer(lines)
    hot = H.hot_keys(counts.select("CustomerID", "Lines"), ["CustomerID"], "Lines")
    pieces = {r.CustomerID: r._pieces for r in hot.collect()}
    assert pieces["Unknown"] >= 64 and pieces["big"] >= 64 and len(pieces) < H.PIECES
    dealt = H.deal_out(lines, hot, ["CustomerID"])
    seen = {r.CustomerID: r.n for r in dealt.groupBy("CustomerID").agg(F.count_distinct(H.PIECE).alias("n")).collect()}
    assert seen["Unknown"] >= 64 and seen["big"] >= 64
    assert {n for c, n in seen.items() if c not in pieces} == {1}
    most = dealt.groupBy("CustomerID", H.PIECE).count().agg(F.max("count")).first()[0]
    assert most < lines.count() / 50


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("known", [True, False])
def test_dealt_joins_give_the_rows_of_plain_joins(lines, how, known):
    customers = Fe.churn_label(Fe.rfm(lines)).filter(F.col("CustomerID") != "c7")
    counts = Fe.per_customer(lines).select("CustomerID", "Lines") if known else lines.sparkSession.createDataFrame([("big", 10**12), ("nobody", 5), (None, 3)], "CustomerID string, Lines long")
    got = H.join_per_key(lines, customers, ["CustomerID"], counts, "Lines", how)
    want = lines.join(customers, "CustomerID", how)
    key = lambda rows: sorted(map(str, rows))
    assert key(got.select(*sorted(got.columns)).collect()) == key(want.select(*sorted(want.columns)).collect())


def test_enriched_lines_count_customers_themselves(lines):
    churn = Fe.churn_label(Fe.rfm(lines))
    plain = lines.join(churn, "CustomerID", "left")
    got = Fe.transactions_with_rfm_churn(lines, churn)
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, plain.select(*sorted(plain.columns)).collect()))


def test_medians_of_many_groups_join_their_brackets(spark):
    """10^5 groups and one that holds a third of the rows: no bracket is broadcast."""
    groups, hot = 100_000, 100_000
    rows = spark.range(3 * groups).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 7919 % groups).cast("int")).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 8).alias("v"))
    rows = rows.cache()
    med = exact_median(rows, ["g"], "v")
    want = rows.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m"))
    assert med.join(want, "g").filter(F.col("median") != F.col("m")).count() == 0
    assert med.count() == want.count() > 60_000
    plan = med._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # what is broadcast is the table of hot groups, which carries only their pieces
    assert all("_pieces" in b or "_n" not in b for b in re.findall(r"BroadcastHashJoin .*", plan)) and "_piece" in plan
    rows.unpersist()
    assert hot == groups


@pytest.mark.parametrize("limit", [0, 10])
def test_median_joins_agree(spark, limit):
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([1.0, 2.5, rnd.random(), None])) for _ in range(4_000)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", accuracy=50, broadcast_groups=limit).collect()}
    assert got == {g: pytest.approx(float(np.median([v for k, v in rows if k == g and v is not None])), abs=1e-12) for g in (0, 1, 2)}
