import datetime as dt
from decimal import Decimal

from tillroll.operators import analysis as A


def final_rows(spark, rows):
    schema = ("CustomerID string, InvoiceNo string, StockCode string, Description string, Quantity int, "
              "InvoiceDate date, UnitPrice decimal(18,3), Country string, Recency int, Frequency long, "
              "Monetary decimal(38,3), Churn int")
    return spark.createDataFrame(rows, schema)


def f(cust="a", code="1", desc="mug", qty=1, year=2011, month=1, price="1.00", country="UK", churn=0,
      recency=0, freq=1, monetary="1.00", inv="1"):
    return (cust, inv, code, desc, qty, dt.date(year, month, 1), Decimal(price), country, recency, freq,
            Decimal(monetary), churn)


def test_product_yoy_two_descriptions_b4(spark):
    df = final_rows(spark, [f(code="1", desc="a", year=2010, price="10"), f(code="1", desc="b", year=2010,
                                                                              price="20"),
                            f(code="1", desc="a", year=2011, price="30"), f(code="1", desc="b", year=2011,
                                                                              price="40")])
    corrected = {(r.Description, r.Year): r.PreviousYearRevenue for r in A.product_yoy(df).collect()}
    assert corrected == {("a", 2011): Decimal("10.000"), ("b", 2011): Decimal("20.000")}
    written = sorted((r.Description, r.Year, r.PreviousYearRevenue) for r in A.product_yoy(df, True).collect())
    # one series per StockCode ordered by (Year, Description)
    assert written == [("a", 2011, Decimal("20.000")), ("b", 2010, Decimal("10.000")),
                       ("b", 2011, Decimal("30.000"))]


def test_country_yoy_gap_and_zero_previous(spark):
    df = final_rows(spark, [f(year=2009, price="5"), f(year=2011, price="7"),
                            f(country="FR", year=2010, price="0"), f(country="FR", year=2011, price="10")])
    got = {(r.Country, r.Year): (r.PreviousRevenue, r.YoY_Growth) for r in A.country_yoy(df).collect()}
    assert got[("UK", 2011)] == (None, None)          # 2010 missing: no previous year
    assert got[("FR", 2011)] == (Decimal("0.000"), None)  # division by zero -> null
    written = {(r.Country, r.Year): r.PreviousRevenue for r in A.country_yoy(df, True).collect()}
    assert written[("UK", 2011)] is not None          # lag takes 2009


def test_customer_in_two_countries_counts_in_each(spark):
    df = final_rows(spark, [f(cust="a", country="UK", churn=1), f(cust="a", country="FR", churn=1)])
    got = {r.Country: r.Churned_Customers for r in A.churn_by_country(df).collect()}
    assert got == {"UK": 1, "FR": 1}


def test_wide_and_long_with_one_sided_country(spark):
    df = final_rows(spark, [f(cust="a", country="UK", churn=0, price="10"),
                            f(cust="b", country="UK", churn=1, price="30"),
                            f(cust="c", country="FR", churn=0, price="8")])
    wide = A.revenue_per_customer_wide(A.revenue_per_customer(df))
    got = {r.Country: (r.Active, r.Churned, r.Total_Avg) for r in wide.collect()}
    assert got == {"UK": (10.0, 30.0, 20.0), "FR": (8.0, None, 8.0)}
    assert [r.Country for r in wide.collect()] == ["UK", "FR"]
    long = {(r.Country, r.Churn_Status): r.Revenue_per_Customer for r in A.revenue_per_customer_long(wide).collect()}
    assert long[("FR", "Churned")] is None and len(long) == 4


def test_top_n_ties_are_broken_deterministically(spark):
    df = final_rows(spark, [f(country=c, price="5") for c in ("B", "A", "C")])
    assert [r.Country for r in A.top_countries(df, 2).collect()] == ["A", "B"]
    assert [r.Country for r in A.top_countries(df, 2, ascending=True).collect()] == ["A", "B"]
    prods = final_rows(spark, [f(desc=d, qty=3) for d in ("z", "y", "x")])
    assert [r.Description for r in A.top_products_by_quantity(prods, 2).collect()] == ["x", "y"]


def test_monthly_top_countries_semi_join(spark):
    df = final_rows(spark, [f(country="UK", price="100"), f(country="FR", price="50", month=2),
                            f(country="DE", price="1")])
    got = sorted((r.Country, r.Month) for r in A.monthly_revenue_top_countries(df, 2).collect())
    assert got == [("FR", 2), ("UK", 1)]
    lab = {r.Country: r.YearMonth for r in A.with_year_month(A.monthly_revenue_top_countries(df, 2)).collect()}
    assert lab == {"UK": "2011-01", "FR": "2011-02"}


def test_monetary_quantile_within_rank_error(spark):
    import random

    rnd = random.Random(7)
    vals = [rnd.randint(0, 10**6) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "Monetary long")
    got = A.monetary_quantile(df, 0.75, 0.01).first()[0]
    rank = sum(v <= got for v in vals) / len(vals)
    assert abs(rank - 0.75) <= 0.01 + 1e-9
    api = A.approx_quantile(df, "Monetary", 0.75, 0.01)
    assert abs(sum(v <= api for v in vals) / len(vals) - 0.75) <= 0.011
