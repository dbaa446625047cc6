"""Analysis queries A1–A24 (place, people, product, growth).

Inputs: ``final`` = lines with invoice day + Recency/Frequency/Monetary/Churn
(one row per invoice line); ``rfm_churn`` = one row per customer.

Where the original analysis weights customers by their line count (averages
and percentiles over lines, a non-distinct self-join) the default here is the
per-customer form; ``*_as_written`` functions / flags reproduce the line-grain
numbers from per-customer rows with a ``Lines`` count, without line-grain joins.

Reports that need customer columns take the lines and, as ``customers``, one row
per customer: lines are first aggregated to (CustomerID, report keys), so the
lines of a hot customer are a few rows before they meet the join. Without
``customers`` the frame must carry the customer columns already.

Every ``limit`` has a total order behind it, so top-n results are
deterministic; Spark plans ``orderBy().limit()`` as TakeOrderedAndProject
(per-task top-n, then a merge of n rows per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import (exact_mean, line_revenue, money_sum, pct_growth, ratio,
                                        year_month_label)
from tillroll.operators.quantiles import exact_quantiles

# --- place / people: RFM by churn, percentiles ------------------------------


def rfm_by_churn(df: DataFrame) -> DataFrame:
    """A1: mean R, F, M and distinct customers per Churn class.

    On ``rfm_churn`` (one row per customer) this is the per-customer profile;
    on ``final`` (one row per line) it is the line-weighted form.
    """
    return df.groupBy("Churn").agg(
        exact_mean("Recency").alias("Avg_Recency"),
        exact_mean("Frequency").alias("Avg_Frequency"),
        exact_mean("Monetary").alias("Avg_Monetary"),
        F.count_distinct("CustomerID").alias("Num_Customers"),
    )


def rfm_by_churn_as_written(weighted: DataFrame) -> DataFrame:
    """A1 line-weighted: each customer counts once for each of its ``Lines``."""
    def mean(c: str) -> Column:
        value = F.col(c).cast("decimal(24,3)") * F.col("Lines").cast("decimal(13,0)")
        return F.try_divide(F.sum(value).cast("double"), F.sum("Lines").cast("double"))

    return weighted.groupBy("Churn").agg(mean("Recency").alias("Avg_Recency"), mean("Frequency").alias("Avg_Frequency"),
                                         mean("Monetary").alias("Avg_Monetary"), F.count(F.lit(1)).alias("Num_Customers"))


def recency_threshold(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A2: exact 25th and 75th percentile of Recency over the rows given (``weight``: a count column)."""
    row = tuple(exact_quantiles(df, "Recency", [0.25, 0.75], weight))
    return df.sparkSession.createDataFrame([row], "recency_25th int, recency_75th int")


def _shrunk(lines: DataFrame, keys: list[str], aggs: list[Column], customers: DataFrame | None, columns: list[str]) -> DataFrame:
    """Lines aggregated to (CustomerID, keys), with customer columns."""
    if customers is None:
        return lines.groupBy("CustomerID", *keys, *columns).agg(*aggs)
    return lines.groupBy("CustomerID", *keys).agg(*aggs).join(customers.select("CustomerID", *columns), "CustomerID")


def recency_customers(customers: DataFrame, high: bool, q: float | None = None, weight: str | None = None) -> DataFrame:
    """Customers at or above the p75 (at or below the p25) of Recency."""
    at = exact_quantiles(customers, "Recency", [q if q is not None else (0.75 if high else 0.25)], weight)[0]
    if at is None:
        return customers.limit(0)
    return customers.filter(F.col("Recency") >= at if high else F.col("Recency") <= at)


def recency_products(lines: DataFrame, rfm_churn: DataFrame, high: bool = True,
                     q: float | None = None) -> DataFrame:
    """A3/A4: lines per StockCode bought by customers with high (low) Recency.

    Threshold = exact p75 (p25) over customers. Lines are counted per customer
    and code before they meet the chosen customers.
    """
    chosen = recency_customers(rfm_churn, high, q).select("CustomerID")
    return (lines.groupBy("CustomerID", "StockCode").agg(F.count(F.lit(1)).alias("_m")).join(chosen, "CustomerID")
            .groupBy("StockCode").agg(F.sum("_m").alias("count")))


def recency_products_as_written(lines: DataFrame, high: bool = True, q: float | None = None,
                                customers: DataFrame | None = None) -> DataFrame:
    """A3/A4 line-weighted: threshold over lines, each line counted once per line
    of its customer (what the non-distinct self-join yields), computed as
    Σ_customer lines(c) · lines(c, code) without building the n² rows."""
    if customers is None:
        customers = lines.groupBy("CustomerID", "Recency").agg(F.count(F.lit(1)).alias("Lines"))
    chosen = recency_customers(customers, high, q, "Lines").select("CustomerID", "Lines")
    return (lines.groupBy("CustomerID", "StockCode").agg(F.count(F.lit(1)).alias("_m")).join(chosen, "CustomerID")
            .groupBy("StockCode").agg(F.sum(F.col("_m") * F.col("Lines")).alias("count")))


def product_descriptions(final: DataFrame) -> DataFrame:
    """One description per StockCode, the alphabetically first.

    A ``min`` aggregate (map-side combined) instead of a row_number window, so a
    hot StockCode is never sorted in one task.
    """
    return (final.select("StockCode", "Description").dropna()
            .groupBy("StockCode").agg(F.min("Description").alias("Description")))


def products_described(products: DataFrame, descriptions: DataFrame, n: int | None = 20) -> DataFrame:
    """Product counts + description, top n by count (StockCode breaks ties); all with ``n=None``."""
    out = (products.join(descriptions, on="StockCode", how="left")
           .select("StockCode", "Description", "count")
           .orderBy(F.col("count").desc(), F.col("StockCode").asc()))
    return out if n is None else out.limit(n)


def stock_top_n(products: DataFrame, n: int = 5, ascending: bool = False) -> DataFrame:
    """N codes with the most (``ascending=False``) or fewest lines."""
    order = F.col("count").asc() if ascending else F.col("count").desc()
    return products.orderBy(order, F.col("StockCode").asc()).limit(n)


def churn_by_country(lines: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Churned / active distinct customers and churn rate per Country.

    Pre-aggregates to distinct (Country, CustomerID) so the two conditional
    distinct counts become plain conditional counts.
    """
    cust = _shrunk(lines, ["Country"], [F.count(F.lit(1)).alias("_n")], customers, ["Churn"])
    agg = cust.groupBy("Country").agg(
        F.count_if(F.col("Churn") == 1).alias("Churned_Customers"),
        F.count_if(F.col("Churn") == 0).alias("Active_Customers"),
    )
    return (agg.withColumn("Churn_Rate", ratio("Churned_Customers",
                                               F.col("Churned_Customers") + F.col("Active_Customers")))
            .orderBy(F.col("Churn_Rate").desc_nulls_last(), F.col("Country").asc()))


def monetary_quantile(df: DataFrame, q: float = 0.75, relative_error: float = 0.01) -> DataFrame:
    """A10: approximate q-quantile of Monetary with the given relative rank error."""
    accuracy = max(1, int(round(1.0 / relative_error)))
    return df.select(F.percentile_approx("Monetary", q, accuracy).alias("Monetary_quantile"))


def quantile_audit(df: DataFrame, q: float = 0.75, relative_error: float = 0.01) -> DataFrame:
    """A10 audited: the rows, and whether the true rank of ``monetary_quantile``'s answer is
    within ``relative_error`` of q, counted exactly in one pass over the rows."""
    found = monetary_quantile(df, q, relative_error).scalar()
    at = df.filter(F.col("Monetary").isNotNull()).select("Monetary", found.alias("_found"))
    n = F.count(F.lit(1))
    lowest, highest = F.count_if(F.col("Monetary") < F.col("_found")), F.count_if(F.col("Monetary") <= F.col("_found"))
    return at.agg(n.alias("n_rows"), ((lowest <= n * (q + relative_error)) & (highest >= n * (q - relative_error))).alias("within_error"))


def approx_quantile(df: DataFrame, column: str, q: float = 0.75,
                    relative_error: float = 0.01) -> float:
    """A10 as a driver-side number (DataFrame.approxQuantile, one small job)."""
    return df.approxQuantile(column, [q], relative_error)[0]


def high_value_churned(df: DataFrame, q: float = 0.75, customers: DataFrame | None = None) -> DataFrame:
    """Churned rows whose Monetary is at least the exact q-quantile.

    The quantile is over the rows given, or, for lines, over ``customers``
    weighted by their ``Lines``.
    """
    at = exact_quantiles(df, "Monetary", [q])[0] if customers is None else exact_quantiles(customers, "Monetary", [q], "Lines")[0]
    out = df.filter((F.col("Churn") == 1) & (F.col("Monetary") >= F.lit(at)))
    return out.select("CustomerID", "Recency", "Frequency", "Monetary")


# --- place: revenue by country, growth, trends -----------------------------


def revenue_by_country(final: DataFrame) -> DataFrame:
    """Σ Quantity·UnitPrice per Country, highest first."""
    return (final.groupBy("Country").agg(money_sum(line_revenue()).alias("Total_Revenue"))
            .orderBy(F.col("Total_Revenue").desc(), F.col("Country").asc()))


def _yoy(yearly: DataFrame, keys: list[str], value: str, prev_name: str,
         consecutive: bool, order_extra: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("Year", *(order_extra or []))
    prev = F.lag(value).over(w)
    if consecutive:
        prev = F.when(F.lag("Year").over(w) == F.col("Year") - 1, prev)
    return yearly.withColumn(prev_name, prev)


def country_yoy(lines: DataFrame, as_written: bool = False, customers: DataFrame | None = None) -> DataFrame:
    """Revenue per Country and Year, previous year's, growth % (2 dp).

    Default: revenue = Σ Quantity·UnitPrice, and the previous value is the
    calendar year before (null on a gap). ``as_written``: yearly value =
    Σ of the customer's lifetime Monetary over lines, previous = last year present.
    """
    with_year = lines.withColumn("Year", F.year("InvoiceDate"))
    if as_written:
        counted = _shrunk(with_year, ["Country", "Year"], [F.count(F.lit(1)).alias("_n")], customers, ["Monetary"])
        weighed = F.col("Monetary").cast("decimal(24,3)") * F.col("_n").cast("decimal(13,0)")
        yearly = counted.groupBy("Country", "Year").agg(money_sum(weighed).alias("YearlyRevenue"))
    else:
        yearly = with_year.groupBy("Country", "Year").agg(money_sum(line_revenue()).alias("YearlyRevenue"))
    out = _yoy(yearly, ["Country"], "YearlyRevenue", "PreviousRevenue", consecutive=not as_written)
    return (out.withColumn("YoY_Growth", F.round(pct_growth("YearlyRevenue", "PreviousRevenue"), 2))
            .orderBy("Country", "Year"))


def top_countries(final: DataFrame, n: int = 3, ascending: bool = False) -> DataFrame:
    """N countries with the highest (lowest) revenue."""
    order = F.col("Total_Revenue").asc() if ascending else F.col("Total_Revenue").desc()
    return (final.groupBy("Country").agg(money_sum(line_revenue()).alias("Total_Revenue"))
            .orderBy(order, F.col("Country").asc()).limit(n))


def monthly_revenue_top_countries(final: DataFrame, n: int = 3, ascending: bool = False) -> DataFrame:
    """Revenue by Year, Month, Country for the top-n countries.

    The n chosen countries (a result bounded by n rows) are broadcast into a
    left-semi join with the monthly rows; no list of countries passes through the
    driver. Ranking and result each aggregate the lines.
    """
    monthly = (final
               .withColumn("Year", F.year("InvoiceDate"))
               .withColumn("Month", F.month("InvoiceDate"))
               .groupBy("Year", "Month", "Country")
               .agg(money_sum(line_revenue()).alias("Total_Revenue")))
    order = F.col("_total").asc() if ascending else F.col("_total").desc()
    top = (monthly.groupBy("Country").agg(F.sum("Total_Revenue").alias("_total"))
           .orderBy(order, F.col("Country").asc()).limit(n).select("Country"))
    return (monthly.join(F.broadcast(top), on="Country", how="left_semi")
            .select("Year", "Month", "Country", "Total_Revenue")
            .orderBy("Year", "Month", "Country"))


def with_year_month(monthly: DataFrame) -> DataFrame:
    """Add the 'YYYY-MM' label, ordered by time."""
    return (monthly.withColumn("YearMonth", year_month_label("Year", "Month"))
            .orderBy("Year", "Month", "Country"))


# --- product -----------------------------------------------------------------


def top_products_by_quantity(final: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """Σ Quantity per Description, top (lowest) n."""
    order = F.col("TotalQuantity").asc() if ascending else F.col("TotalQuantity").desc()
    return (final.groupBy("Description").agg(F.sum("Quantity").alias("TotalQuantity"))
            .orderBy(order, F.col("Description").asc()).limit(n))


def churned_top_products(lines: DataFrame, n: int = 3, customers: DataFrame | None = None) -> DataFrame:
    """Products churned customers bought most, by quantity."""
    bought = _shrunk(lines, ["StockCode", "Description"], [F.sum("Quantity").alias("_q")], customers, ["Churn"])
    return (bought.filter(F.col("Churn") == 1)
            .groupBy("StockCode", "Description").agg(F.sum("_q").alias("TotalQuantity"))
            .orderBy(F.col("TotalQuantity").desc(), F.col("StockCode").asc(), F.col("Description").asc())
            .limit(n))


def product_yoy(final: DataFrame, as_written: bool = False) -> DataFrame:
    """Revenue per StockCode, Description, Year with the previous year's
    and the growth %, rows that have a previous value only.

    Default: the series is (StockCode, Description) and the previous value is
    the calendar year before. ``as_written``: series per StockCode (Description
    orders ties), previous = last year present.
    """
    yearly = (final.withColumn("Year", F.year("InvoiceDate"))
              .groupBy("StockCode", "Description", "Year")
              .agg(money_sum(line_revenue()).alias("YearlyRevenue")))
    if as_written:
        out = _yoy(yearly, ["StockCode"], "YearlyRevenue", "PreviousYearRevenue",
                   consecutive=False, order_extra=["Description"])
    else:
        out = _yoy(yearly, ["StockCode", "Description"], "YearlyRevenue", "PreviousYearRevenue",
                   consecutive=True)
    return (out.withColumn("YoY_Growth", pct_growth("YearlyRevenue", "PreviousYearRevenue"))
            .filter(F.col("PreviousYearRevenue").isNotNull()))


def top_growth_products(yoy: DataFrame, n: int = 20) -> DataFrame:
    """Highest growth first (nulls last, full tie-break)."""
    return (yoy.orderBy(F.col("YoY_Growth").desc_nulls_last(), F.col("StockCode").asc(),
                        F.col("Description").asc(), F.col("Year").asc())
            .limit(n))


# --- people: revenue per customer ------------------------------------------


def revenue_per_customer(lines: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Revenue, distinct customers and revenue per customer by Country, Churn."""
    spent = _shrunk(lines, ["Country"], [money_sum(line_revenue()).alias("_r")], customers, ["Churn"])
    return (spent.groupBy("Country", "Churn").agg(
        money_sum("_r").alias("Total_Revenue"),
        F.count(F.lit(1)).alias("Num_Customers"))
        .withColumn("Revenue_per_Customer", ratio("Total_Revenue", "Num_Customers")))


def revenue_per_customer_wide(per_customer: DataFrame) -> DataFrame:
    """One row per Country with Active / Churned revenue per customer and
    their mean ignoring a missing side, highest mean first."""
    wide = (per_customer.groupBy("Country").pivot("Churn", [0, 1])
            .agg(F.first("Revenue_per_Customer"))
            .withColumnRenamed("0", "Active").withColumnRenamed("1", "Churned"))
    present = (F.col("Active").isNotNull().cast("int") + F.col("Churned").isNotNull().cast("int"))
    total = F.coalesce(F.col("Active"), F.lit(0.0)) + F.coalesce(F.col("Churned"), F.lit(0.0))
    return (wide.withColumn("Total_Avg", F.try_divide(total, present.cast("double")))
            .orderBy(F.col("Total_Avg").desc_nulls_last(), F.col("Country").asc()))


def revenue_per_customer_long(wide: DataFrame) -> DataFrame:
    """Wide -> long (Country, Churn_Status, Revenue_per_Customer); a
    missing side stays as a null row."""
    return wide.unpivot("Country", ["Active", "Churned"], "Churn_Status", "Revenue_per_Customer")


def top_customers(rfm_churn: DataFrame, column: str = "Monetary", n: int = 5,
                  ascending: bool = False) -> DataFrame:
    """N customers with the highest (lowest) value of ``column``."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return rfm_churn.orderBy(order, F.col("CustomerID").asc()).limit(n)
