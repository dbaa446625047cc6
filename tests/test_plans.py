"""Plans of reports: lines are read once besides the per-customer pass, and the
hot customer's raw lines meet no join on CustomerID alone."""

import re

import pytest

import __spark_entry__ as E
from tillroll.operators.quantiles import exact_quantiles

SF = "/root/testdata/sf0.001"
LINE_REPORTS = ["transactions_with_churn", "transactions_with_rfm_churn", "rfm_with_transactions", "high_value_churned_as_written", "segment_input_as_written"]
SHRUNK_REPORTS = ["churn_by_country", "revenue_per_customer", "churned_top_products", "country_yoy_as_written", "high_recency_products",
                  "low_recency_products_as_written", "rfm_by_churn_as_written", "recency_threshold_as_written"]


def executed(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LINE_REPORTS + SHRUNK_REPORTS)
def test_lines_are_read_once_after_the_customers(spark, name):
    assert executed(spark, name).split("== Initial Plan ==")[0].count("lineitem.parquet") <= 1


@pytest.mark.parametrize("name", LINE_REPORTS)
def test_line_joins_are_dealt_out_in_pieces(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
    on_customer = [j for j in joins if j.startswith("CustomerID")]
    assert on_customer and all("_piece" in j for j in on_customer)


@pytest.mark.parametrize("name", ["churn_by_country", "revenue_per_customer", "churned_top_products", "high_recency_products"])
def test_reports_aggregate_lines_before_the_customer_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[re.search(r"Join Inner, \(CustomerID", plan).end():]
    assert re.search(r"Aggregate \[CustomerID", join)


def test_exact_quantiles_equal_sorting(spark):
    import random
    from decimal import Decimal

    rnd = random.Random(2)
    rows = [(rnd.randrange(5000), Decimal(rnd.randrange(-10**9, 10**9)).scaleb(-3), rnd.randrange(1, 50)) for _ in range(3000)] + [(None, None, 4)]
    df = spark.createDataFrame(rows, "a int, b decimal(18,3), w int")
    for column, i in (("a", 0), ("b", 1)):
        for weight in (None, "w"):
            long = sorted(v for r in rows if r[i] is not None for v in [r[i]] * (r[2] if weight else 1))
            for q in (0.0, 0.25, 0.5, 0.75, 1.0):
                want = long[max(1, -(-int(q * 100) * len(long) // 100)) - 1]
                assert exact_quantiles(df, column, [q], weight) == [want]
    assert exact_quantiles(df.limit(0), "a", [0.5]) == [None]
