import datetime as dt
import os
import sys
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators import analysis as A
from tillroll.operators import features as Fe
from tillroll.plans.prepared import RetailTables
from tillroll.schemas import FEATURES_IN

SF = "/root/testdata/sf0.001"


def fe_rows(spark, rows):
    return spark.createDataFrame(rows, FEATURES_IN)


def line(cust, inv, day, qty=1, price="1.00", code="10", desc="mug", country="UK"):
    return (inv, code, desc, qty, day, Decimal(price), cust, country)


def test_churn_thresholds_are_strict_and_inclusive(spark):
    df = spark.createDataFrame([("a", 95, 7), ("b", 96, 7), ("c", 96, 8), ("d", 95, 8)],
                               "CustomerID string, Recency int, Frequency long")
    got = {r.CustomerID: r.Churn for r in Fe.churn_label(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 0}


def test_rfm_equals_the_oracle_sql(spark):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
    from check_oracle import duck, rows_of
    from oracle_sql import ORACLE

    t = RetailTables.from_testdata(spark, SF)
    res = duck(SF).execute(ORACLE["rfm"])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    for df in (t.rfm(), Fe.rfm(t.features_in)):
        assert rows_of(df.columns, df.collect()) == want


def test_rfm_values_on_literal_lines(spark):
    d = dt.date
    df = fe_rows(spark, [line("A", "1", d(2011, 1, 1), 2, "1.50"), line("A", "1", d(2011, 1, 1)),
                         line("A", "2", d(2011, 1, 5)), line("B", "3", d(2011, 1, 10), 3, "2.00")])
    got = {r.CustomerID: (r.Recency, r.Frequency, r.Monetary) for r in Fe.rfm(df).collect()}
    assert got == {"A": (5, 2, Decimal("5.000")), "B": (0, 1, Decimal("6.000"))}


def test_revenue_over_countries_equals_total_monetary(spark):
    t = RetailTables.from_testdata(spark, SF)
    total_rev = A.revenue_by_country(t.final).agg(F.sum("Total_Revenue")).first()[0]
    total_m = t.rfm().agg(F.sum("Monetary")).first()[0]
    assert total_rev == total_m


def test_active_plus_churned_equals_customers_per_country(spark):
    t = RetailTables.from_testdata(spark, SF)
    got = {r.Country: r.Churned_Customers + r.Active_Customers for r in A.churn_by_country(t.final).collect()}
    want = {r.Country: r.n for r in t.final.groupBy("Country").agg(
        F.count_distinct("CustomerID").alias("n")).collect()}
    assert got == want


def test_grain_weighting_b1_b2(spark):
    d = dt.date(2011, 1, 1)
    # customer A: 1 line, customer B: 3 lines; both qualify
    lines = fe_rows(spark, [line("A", "1", d, code="x"), line("B", "2", d, code="x"),
                            line("B", "3", d, code="y"), line("B", "4", d, code="y")])
    rfm = Fe.churn_label(Fe.rfm(lines))
    final = Fe.transactions_with_rfm_churn(lines, rfm)
    weighted = {r.StockCode: r["count"] for r in A.recency_products_as_written(final, high=True).collect()}
    # n^2 self-join: x <- A(1*1) + B(3*1) = 4, y <- B(3*2) = 6
    assert weighted == {"x": 4, "y": 6}
    plain = {r.StockCode: r["count"] for r in A.recency_products(final, rfm, high=True).collect()}
    assert plain == {"x": 2, "y": 2}
    # line-weighted mean Frequency vs per customer
    per_line = A.rfm_by_churn(final).first().Avg_Frequency
    per_customer = A.rfm_by_churn(rfm).first().Avg_Frequency
    assert per_customer == 2.0 and per_line == (1 + 3 * 3) / 4
