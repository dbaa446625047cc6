import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.sources import files, testdata
from tillroll.schemas import RAW

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_with_declared_schema(spark, scratch):
    raw = testdata.raw_retail(spark, SF)
    raw.write.option("header", True).csv(f"{scratch}/raw_csv")
    back = files.load_transactions(spark, f"{scratch}/raw_csv")
    assert back.schema == RAW
    assert sorted(back.collect()) == sorted(raw.collect())


def test_write_prepared_partitions_by_year_and_reads_back(spark, scratch):
    cleaned = C.clean_transactions(testdata.raw_retail(spark, SF))
    files.write_prepared(cleaned, f"{scratch}/cleaned")
    back = files.load_prepared(spark, f"{scratch}/cleaned")
    assert back.count() == cleaned.count()
    years = {r.Year for r in back.select("Year").distinct().collect()}
    assert years == {r.y for r in cleaned.select(F.year("InvoiceDate").alias("y")).distinct().collect()}
    plan = back.filter(F.col("Year") == min(years))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_preview_is_ordered_and_bounded(spark):
    raw = testdata.raw_retail(spark, SF)
    p = files.preview(raw, 5).collect()
    assert len(p) == 5 and p == sorted(p, key=lambda r: tuple((x is not None, x) for x in r))


def test_collect_bounded_refuses_large_results(spark):
    df = spark.range(20)
    assert len(files.collect_bounded(df, 20)) == 20
    with pytest.raises(ValueError):
        files.collect_bounded(df, 19)


def test_retail_adapter_is_clean(spark):
    r = testdata.retail(spark, SF)
    assert r.count() == 6000
    assert C.clean_transactions(r.withColumn("InvoiceDate", F.date_format("InvoiceDate", "M/d/yyyy H:mm"))).count() <= 6000
