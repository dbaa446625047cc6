"""Repeated rows by 128-bit keys: same rows and counts as whole-row grouping, far less shuffled."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import duplicates as D
from tillroll.operators import profile as P

SCHEMA = "a string, b string, c int, d date, e decimal(18,3), f double"


@pytest.fixture(scope="module")
def rows(spark):
    """A row that is a third of all, nulls in turn in every column, equal values in other columns."""
    rnd = random.Random(4)
    out = [("hot", "x", 1, dt.date(2011, 1, 1), Decimal("1.500"), 0.5)] * 400
    for _ in range(800):
        out.append((rnd.choice(["p", "q", None]), rnd.choice(["p", "q", None]), rnd.choice([1, 2, None]), rnd.choice([dt.date(2011, 1, 1), None]),
                    rnd.choice([Decimal("1.000"), None]), rnd.choice([0.0, -0.0, float("nan"), None])))
    return spark.createDataFrame(out, SCHEMA).repartition(5).cache()


def plain(df):
    return sorted(map(str, df.dropDuplicates().withColumn("f", F.col("f") + 0.0).collect()))


def test_nulls_do_not_change_places(spark):
    df = spark.createDataFrame([("p", None), (None, "p"), ("p", ""), (None, None), ("", None)], "a string, b string")
    assert D.with_key(df).select(*D.KEYS).distinct().count() == 5 and D.duplicate_rows(df).first()[0] == 0


def test_count_equals_whole_rows(rows):
    assert D.duplicate_rows(rows).first().duplicate_rows == rows.count() - rows.dropDuplicates().count()
    assert D.duplicate_rows(rows.limit(0)).first().duplicate_rows == 0
    assert P.profile_duplicates(rows).first().duplicate_rows == rows.count() - rows.dropDuplicates().count()


@pytest.mark.parametrize("max_keys", [D.MAX_KEYS, 3])
def test_rows_equal_whole_row_deduplication(rows, max_keys):
    got = D.deduplicate(rows, max_keys)
    assert got.columns == rows.columns
    assert sorted(map(str, got.withColumn("f", F.col("f") + 0.0).collect())) == plain(rows)


def test_rows_without_repeats_pass_unshuffled(rows):
    once = rows.dropDuplicates().cache()
    got = D.deduplicate(once)
    assert got.count() == once.count()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_only_repeated_rows_are_shuffled_whole(rows):
    wide = D.deduplicate(rows)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Aggregate [") == 1  # whole rows are grouped on the repeated side alone
