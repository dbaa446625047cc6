"""Malformed lines are set aside whole, with their reasons; all others load typed."""

from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.schemas import RAW
from tillroll.sources import files

LINES = [
    "536365,85123A,red mug,6,12/1/2010 8:26,2.55,17850,United Kingdom",
    '536366,10,"mug, blue",-1,12/1/2010 8:26,0.000,,France',
    "536367,10,mug,six,12/1/2010 8:26,2.55,1,France",
    "536368,10,mug,6,31/31/2010 8:26,free,1,France",
    "536369,10,mug,6,12/1/2010 8:26",
    "536370,10,mug,6,12/1/2010 8:26,2.55,1,France,more",
    "",
    "   ",
    ",,,,,,,",
    "536371,10,mug,99999999999,12/1/2010 8:26,2.55,1,France",
    "536372,10,mug,1,,2.55,1,France",
]


def write(spark, path, lines, header=True):
    spark.createDataFrame([(x,) for x in ([",".join(f.name for f in RAW.fields)] if header else []) + lines], "value string").coalesce(1).write.text(path)


def test_bad_lines_are_kept_whole(spark, scratch):
    write(spark, f"{scratch}/in", LINES)
    got = files.load_checked(spark, f"{scratch}/in")
    assert got.good.schema.simpleString() == RAW.simpleString()
    assert [r.InvoiceNo for r in got.good.orderBy(F.col("InvoiceNo").asc_nulls_first()).collect()] == [None, "536365", "536366", "536372"]
    blue = got.good.filter("InvoiceNo = '536366'").first()
    assert (blue.Description, blue.Quantity, blue.UnitPrice, blue.CustomerID) == ("mug, blue", -1, Decimal("0.000"), None)
    assert {r.line: list(r.reasons) for r in got.bad.collect()} == {
        LINES[2]: ["Quantity"], LINES[3]: ["InvoiceDate", "UnitPrice"], LINES[4]: ["fields"], LINES[5]: ["fields"], LINES[9]: ["Quantity"]}
    assert {r.reason: r.lines for r in got.counts().collect()} == {"Quantity": 2, "InvoiceDate": 1, "UnitPrice": 1, "fields": 2}
    got.write_quarantine(f"{scratch}/bad")
    assert spark.read.parquet(f"{scratch}/bad").count() == 5


def test_mended_lines_load_again(spark, scratch):
    write(spark, f"{scratch}/in", LINES)
    bad = files.load_checked(spark, f"{scratch}/in").bad
    mended = bad.filter(F.array_contains("reasons", "Quantity")).select(F.regexp_replace("line", "six|9{11}", "6").alias("value"))
    mended.write.text(f"{scratch}/mended")
    again = files.load_checked(spark, f"{scratch}/mended", header=False)
    assert again.good.count() == 2 and again.bad.count() == 0


def test_lines_of_nothing(spark, scratch):
    write(spark, f"{scratch}/in", [])
    got = files.load_checked(spark, f"{scratch}/in")
    assert got.good.count() == got.bad.count() == got.counts().count() == 0


def test_one_pass_without_a_shuffle(spark, scratch):
    write(spark, f"{scratch}/in", LINES, header=False)
    got = files.load_checked(spark, f"{scratch}/in", header=False)
    for df in (got.good, got.bad):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
