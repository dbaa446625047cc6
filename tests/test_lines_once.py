"""Lines are cleaned once where a query needs them again, and deduplicated in tasks of their own."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean, features
from tillroll.plans.catalog import all_queries
from tillroll.plans.prepared import RetailTables


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f"{i % 60}", f"s{i % 7}", f"d{i % 7}" if i % 11 else None, i % 5, None if i % 13 == 0 else f"1/{1 + i % 28}/2011 8:00", None if i % 17 == 0 else 2.5,
             None if i % 4 == 0 else f"c{i % 9}", "X") for i in range(300)]
    return spark.createDataFrame(rows + rows[:40], "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID string, Country string"
                                 ).withColumn("UnitPrice", F.col("UnitPrice").cast("decimal(12,3)"))


def test_customers_are_written_from_the_written_lines(spark, raw, scratch, monkeypatch):
    inputs, made = [], features.per_customer
    monkeypatch.setattr(features, "per_customer", lambda df: inputs.append(df) or made(df))
    RetailTables(raw).write(f"{scratch}/lines", f"{scratch}/customers")
    assert len(inputs) == 1 and all(f"{scratch}/lines/" in f for f in inputs[0].inputFiles()) and inputs[0].inputFiles()
    got = spark.read.parquet(f"{scratch}/customers")
    want = made(RetailTables(raw).features_in)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["low_recency_products", "high_recency_products_as_written", "low_recency_products_described_all"])
def test_recency_products_do_not_join_the_tables_again(spark, name):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")
    assert plan.inputFiles() and not any("lineitem" in f for f in plan.inputFiles())


def test_kept_lines_give_the_same_tables(raw):
    t, kept = RetailTables(raw), RetailTables(raw).kept("StockCode")
    assert sorted(map(str, kept.weighted().collect())) == sorted(map(str, t.weighted().collect()))
    assert sorted(map(str, kept.cleaned.collect())) == sorted(map(str, t.cleaned.select(kept.cleaned.columns).collect()))
    assert kept.kept("StockCode") is kept


def test_whole_rows_are_grouped_in_rebalanced_tasks(raw):
    cleaned = clean.clean_transactions(raw)
    assert "RebalancePartitions" in cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, cleaned.collect())) == sorted(map(str, {str(r): r for r in cleaned.collect()}.values()))
