"""Independent DuckDB SQL for every oracle-checked query in the registry.

Written from the definitions, not from the Spark code, and in a different
form where one exists (three aggregates joined for RFM, self-joins for the
year-over-year series, row_number for descriptions, the literal non-distinct
self-join for the line-weighted product counts, ...). The base views
``lineitem orders part customer nation`` are the driver's parquet views.
"""

from __future__ import annotations

from tillroll.schemas import COLUMN_ROLES, KMEANS_K_RANGE, RAW, SEGMENT_LABELS

EXCLUDED = ("'POST', 'DOT', 'M', 'C2', 'BANK CHARGES', 'S', 'B', 'AMAZONFEE', "
            "'gift_0001_10', 'gift_0001_20', 'gift_0001_30', 'gift_0001_40', 'gift_0001_50'")

RAW_COLS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
            "CustomerID", "Country"]

BASE = f"""
star AS (
  SELECT l.l_orderkey AS k, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_returnflag AS rf,
         l.l_quantity AS qty, o.o_orderdate AS odate, c.c_custkey AS ck, n.n_name AS nname,
         p.p_name AS pname, p.p_retailprice AS price
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey),
raw_once AS (
  SELECT k AS _k,
    CASE WHEN rf = 'R' AND k % 25 = 0 THEN 'C' || CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS InvoiceNo,
    CASE WHEN pk % 250 = 3 THEN 'POST' WHEN pk % 250 = 4 THEN 'M' ELSE CAST(pk AS VARCHAR) END AS StockCode,
    CASE WHEN pk % 300 = 7 THEN NULL ELSE pname END AS Description,
    CASE WHEN rf = 'R' AND k % 25 = 0 THEN -CAST(qty AS INTEGER)
         WHEN (k + ln) % 211 = 0 THEN -1 ELSE CAST(qty AS INTEGER) END AS Quantity,
    strftime(odate, '%-m/%-d/%Y %-H:%M') AS InvoiceDate,
    CASE WHEN (k + ln) % 199 = 0 THEN CAST(0 AS DECIMAL(18,3))
         WHEN (k + ln) % 997 = 0 THEN -CAST(price AS DECIMAL(18,3))
         ELSE CAST(price AS DECIMAL(18,3)) END AS UnitPrice,
    CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(ck AS VARCHAR) END AS CustomerID,
    nname AS Country
  FROM star),
raw_retail AS (
  SELECT * EXCLUDE (_k) FROM raw_once
  UNION ALL
  SELECT * EXCLUDE (_k) FROM raw_once WHERE _k % 100 = 1),
parsed AS (
  SELECT * REPLACE (CAST(try_strptime(InvoiceDate, '%m/%d/%Y %H:%M') AS TIMESTAMP) AS InvoiceDate)
  FROM raw_retail),
c2 AS (SELECT * FROM parsed WHERE Description IS NOT NULL),
c3 AS (SELECT * REPLACE (coalesce(CustomerID, 'Unknown') AS CustomerID) FROM c2),
c4 AS (SELECT DISTINCT * FROM c3),
c5 AS (SELECT * FROM c4 WHERE Quantity > 0 AND UnitPrice > 0),
cleaned AS (SELECT * FROM c5 WHERE StockCode NOT IN ({EXCLUDED})),
fe AS (SELECT * REPLACE (CAST(InvoiceDate AS DATE) AS InvoiceDate) FROM cleaned),
maxd AS (SELECT max(InvoiceDate) AS d FROM fe),
rec AS (
  SELECT CustomerID, CAST(date_diff('day', max(InvoiceDate), (SELECT d FROM maxd)) AS INTEGER) AS Recency
  FROM fe GROUP BY CustomerID),
frq AS (SELECT CustomerID, count(DISTINCT InvoiceNo) AS Frequency FROM fe GROUP BY CustomerID),
mon AS (
  SELECT CustomerID, CAST(round(sum(Quantity * UnitPrice), 3) AS DECIMAL(38,3)) AS Monetary
  FROM fe GROUP BY CustomerID),
rfm AS (
  SELECT rec.CustomerID, rec.Recency, frq.Frequency, mon.Monetary
  FROM rec JOIN frq ON rec.CustomerID = frq.CustomerID JOIN mon ON rec.CustomerID = mon.CustomerID),
rfm_churn AS (
  SELECT *, CASE WHEN Recency > 95 AND Frequency <= 7 THEN 1 ELSE 0 END AS Churn FROM rfm),
final AS (
  SELECT fe.*, r.Recency, r.Frequency, r.Monetary, r.Churn
  FROM fe LEFT JOIN rfm_churn r ON fe.CustomerID = r.CustomerID)"""


def q(body: str, *extra_ctes: str) -> str:
    ctes = BASE + "".join(",\n" + c for c in extra_ctes)
    return f"WITH {ctes}\n{body}"


def _order_all(cols=RAW_COLS) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


def _cnt(table: str, where: str = "TRUE") -> str:
    return f"(SELECT count(*) FROM {table} WHERE {where})"


def _dmean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / count({c})"


REV = "Quantity * UnitPrice"
MONEY = "DECIMAL(38,3)"

_THR_HIGH = "thr AS (SELECT quantile_disc(Recency, 0.75) AS t FROM rfm_churn)"
_THR_LOW = "thr AS (SELECT quantile_disc(Recency, 0.25) AS t FROM rfm_churn)"
_THR_HIGH_LINES = "thr AS (SELECT quantile_disc(Recency, 0.75) AS t FROM final)"
_THR_LOW_LINES = "thr AS (SELECT quantile_disc(Recency, 0.25) AS t FROM final)"


def _products(op: str, thr_cte: str) -> str:
    cte = (f"{thr_cte},\nproducts AS (SELECT StockCode, count(*) AS \"count\" FROM final "
           f"WHERE CustomerID IN (SELECT CustomerID FROM rfm_churn WHERE Recency {op} (SELECT t FROM thr)) "
           f"GROUP BY StockCode)")
    return cte


def _products_as_written(op: str, thr_cte: str) -> str:
    # the literal non-distinct self-join: every qualifying line joined to every
    # line of the same customer
    return (f"{thr_cte},\nproducts AS (SELECT f.StockCode, count(*) AS \"count\" "
            f"FROM (SELECT CustomerID FROM final WHERE Recency {op} (SELECT t FROM thr)) h "
            f"JOIN final f ON h.CustomerID = f.CustomerID GROUP BY f.StockCode)")


DESC = ("descs AS (SELECT StockCode, Description FROM ("
        "SELECT StockCode, Description, row_number() OVER (PARTITION BY StockCode ORDER BY Description) AS rn "
        "FROM final WHERE StockCode IS NOT NULL AND Description IS NOT NULL) WHERE rn = 1)")

DESCRIBED = ("SELECT p.StockCode, d.Description, p.\"count\" FROM products p "
             "LEFT JOIN descs d ON p.StockCode = d.StockCode "
             "ORDER BY p.\"count\" DESC, p.StockCode ASC LIMIT 20")

COUNTRY_YEAR = (f"yearly AS (SELECT Country, CAST(year(InvoiceDate) AS INTEGER) AS Year, "
                f"CAST(sum({REV}) AS {MONEY}) AS YearlyRevenue FROM final GROUP BY 1, 2)")
COUNTRY_YEAR_MONETARY = ("yearly AS (SELECT Country, CAST(year(InvoiceDate) AS INTEGER) AS Year, "
                         f"CAST(sum(Monetary) AS {MONEY}) AS YearlyRevenue FROM final GROUP BY 1, 2)")


def _growth(cur: str, prev: str) -> str:
    return f"(CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / nullif(CAST({prev} AS DOUBLE), 0) * 100.0"


PRODUCT_YEAR = (f"py AS (SELECT StockCode, Description, CAST(year(InvoiceDate) AS INTEGER) AS Year, "
                f"CAST(sum({REV}) AS {MONEY}) AS YearlyRevenue FROM final GROUP BY 1, 2, 3)")

PRODUCT_YOY = (f"{PRODUCT_YEAR},\nyoy AS (SELECT a.StockCode, a.Description, a.Year, a.YearlyRevenue, "
               f"b.YearlyRevenue AS PreviousYearRevenue, {_growth('a.YearlyRevenue', 'b.YearlyRevenue')} AS YoY_Growth "
               f"FROM py a JOIN py b ON a.StockCode = b.StockCode AND a.Description = b.Description "
               f"AND b.Year = a.Year - 1)")

PRODUCT_YOY_AS_WRITTEN = (
    f"{PRODUCT_YEAR},\nlagged AS (SELECT *, lag(YearlyRevenue) OVER (PARTITION BY StockCode ORDER BY Year, Description) "
    f"AS PreviousYearRevenue FROM py),\n"
    f"yoy AS (SELECT *, {_growth('YearlyRevenue', 'PreviousYearRevenue')} AS YoY_Growth FROM lagged "
    f"WHERE PreviousYearRevenue IS NOT NULL)")

PER_CUSTOMER = (f"rpc AS (SELECT Country, Churn, CAST(sum({REV}) AS {MONEY}) AS Total_Revenue, "
                f"count(DISTINCT CustomerID) AS Num_Customers FROM final GROUP BY Country, Churn)")
WIDE = (f"{PER_CUSTOMER},\nw0 AS (SELECT Country, "
        f"max(CASE WHEN Churn = 0 THEN CAST(Total_Revenue AS DOUBLE) / nullif(CAST(Num_Customers AS DOUBLE), 0) END) AS Active, "
        f"max(CASE WHEN Churn = 1 THEN CAST(Total_Revenue AS DOUBLE) / nullif(CAST(Num_Customers AS DOUBLE), 0) END) AS Churned "
        f"FROM rpc GROUP BY Country),\n"
        f"wide AS (SELECT *, (coalesce(Active, 0.0) + coalesce(Churned, 0.0)) / "
        f"nullif(CAST(CAST(Active IS NOT NULL AS INTEGER) + CAST(Churned IS NOT NULL AS INTEGER) AS DOUBLE), 0) "
        f"AS Total_Avg FROM w0)")

MONTHLY_TOP3 = (f"top3 AS (SELECT Country FROM final GROUP BY Country ORDER BY sum({REV}) DESC, Country LIMIT 3),\n"
                f"monthly AS (SELECT CAST(year(InvoiceDate) AS INTEGER) AS Year, CAST(month(InvoiceDate) AS INTEGER) AS Month, "
                f"Country, CAST(sum({REV}) AS {MONEY}) AS Total_Revenue FROM final "
                f"WHERE Country IN (SELECT Country FROM top3) GROUP BY 1, 2, 3)")

_SCHEMA_ROWS = """
SELECT * FROM (VALUES
  (0, 'InvoiceNo', 'string', 'string', 'identifier', 'invoice id; a leading C marks a cancellation', 0),
  (1, 'StockCode', 'string', 'string', 'identifier', 'product id; some codes are not products', 0),
  (2, 'Description', 'string', 'string', 'attribute', 'product name', 0),
  (3, 'Quantity', 'int', 'int', 'measure', 'units; negative on returns', 0),
  (4, 'InvoiceDate', 'string', 'timestamp_ntz', 'time', 'invoice time as text M/d/yyyy H:mm',
     (SELECT count(*) FROM raw_retail WHERE InvoiceDate IS NOT NULL
        AND try_strptime(InvoiceDate, '%m/%d/%Y %H:%M') IS NULL)),
  (5, 'UnitPrice', 'decimal(18,3)', 'decimal(18,3)', 'measure', 'price per unit', 0),
  (6, 'CustomerID', 'string', 'string', 'identifier', 'customer id; null when unknown', 0),
  (7, 'Country', 'string', 'string', 'attribute', 'country of the customer', 0)
) AS t(position, column_name, stored_type, target_type, role, meaning, unconvertible)"""


def _nulls(table: str) -> str:
    return "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in RAW_COLS) + f" FROM {table}"


def _preview(where: str, cols: list[str]) -> str:
    return f"SELECT {', '.join(cols)} FROM c4 WHERE {where} ORDER BY {_order_all(cols)} LIMIT 5"


ORACLE: dict[str, str] = {
    # sources
    "load_transactions": q("SELECT * FROM raw_retail"),
    "preview": q(f"SELECT * FROM raw_retail ORDER BY {_order_all()} LIMIT 5"),
    # profiling
    "profile_shape": q("SELECT 8 AS n_columns, count(*) AS n_rows FROM raw_retail"),
    "profile_schema": q(_SCHEMA_ROWS.replace("(SELECT count(*)", "(SELECT CAST(count(*) AS BIGINT)")
                        .replace("', 0)", "', CAST(0 AS BIGINT))")),
    "profile_nulls": q(_nulls("parsed")),
    "profile_nulls_cleaned": q(_nulls("c3")),
    "profile_duplicates": q("SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c3)) AS BIGINT) "
                            "AS duplicate_rows FROM c3"),
    "profile_cancelled": q("SELECT count(*) AS cancelled_rows FROM c4 WHERE starts_with(InvoiceNo, 'C')"),
    "profile_negative_quantity": q("SELECT count(*) AS negative_quantity_rows FROM c4 WHERE Quantity < 0"),
    "profile_negative_price": q("SELECT count(*) AS negative_price_rows FROM c4 WHERE UnitPrice < 0"),
    "profile_cancelled_preview": q(_preview("starts_with(InvoiceNo, 'C')", RAW_COLS)),
    "profile_negative_quantity_preview": q(_preview("Quantity < 0", ["InvoiceNo", "Quantity"])),
    "profile_negative_price_preview": q(_preview("UnitPrice < 0", ["InvoiceNo", "UnitPrice"])),
    "stockcodes_missing_description": q("SELECT DISTINCT StockCode FROM parsed WHERE Description IS NULL"),
    "stockcodes_missing_description_count": q("SELECT count(DISTINCT StockCode) AS n_stockcodes FROM parsed "
                                              "WHERE Description IS NULL"),
    "excluded_code_pairs": q(f"SELECT DISTINCT StockCode, Description FROM c5 WHERE StockCode IN ({EXCLUDED})"),
    "cleaning_report": q(f"""SELECT * FROM (VALUES
        (0, 'raw', {_cnt('raw_retail')}),
        (1, 'drop_missing_description', {_cnt('c2')}),
        (2, 'deduplicate', {_cnt('c4')}),
        (3, 'positive', {_cnt('c5')}),
        (4, 'exclude_codes', {_cnt('cleaned')}),
        (5, 'zero_quantity_after_dedup', {_cnt('c4', 'Quantity = 0')}),
        (6, 'zero_price_after_dedup', {_cnt('c4', 'UnitPrice = 0')}),
        (7, 'unparsed_dates', {_cnt('parsed', 'InvoiceDate IS NULL')})
        ) AS t(step_no, step, "rows")"""),
    "latest_transaction": q("SELECT max(CAST(InvoiceDate AS DATE)) AS latest_date FROM cleaned"),
    # cleaning
    "clean_parse_date": q("SELECT * FROM parsed"),
    "clean_drop_missing_description": q("SELECT * FROM c2"),
    "clean_fill_customer": q("SELECT * FROM c3"),
    "clean_deduplicate": q("SELECT * FROM c4"),
    "clean_positive": q("SELECT * FROM c5"),
    "clean_exclude_codes": q("SELECT * FROM cleaned"),
    "clean_transactions": q("SELECT * FROM cleaned"),
    # features
    "to_invoice_date": q("SELECT * FROM fe"),
    "rfm_recency": q("SELECT CustomerID, Recency FROM rec"),
    "rfm_frequency": q("SELECT CustomerID, Frequency FROM frq"),
    "rfm_monetary": q("SELECT CustomerID, Monetary FROM mon"),
    "rfm": q("SELECT * FROM rfm"),
    "rfm_means": q(f"SELECT {_dmean('Recency')} AS Mean_Recency, {_dmean('Frequency')} AS Mean_Frequency, "
                   f"{_dmean('Monetary')} AS Mean_Monetary FROM rfm"),
    "churn_label": q("SELECT * FROM rfm_churn"),
    "transactions_with_churn": q("SELECT c.*, r.Churn FROM cleaned c LEFT JOIN rfm_churn r "
                                 "ON c.CustomerID = r.CustomerID"),
    "transactions_with_rfm_churn": q("SELECT * FROM final"),
    "rfm_with_transactions": q("SELECT r.*, c.* EXCLUDE (CustomerID) FROM rfm r "
                               "LEFT JOIN cleaned c ON r.CustomerID = c.CustomerID"),
    # analysis
    "rfm_by_churn": q(f"SELECT Churn, {_dmean('Recency')} AS Avg_Recency, {_dmean('Frequency')} AS Avg_Frequency, "
                      f"{_dmean('Monetary')} AS Avg_Monetary, count(DISTINCT CustomerID) AS Num_Customers "
                      f"FROM rfm_churn GROUP BY Churn"),
    "rfm_by_churn_as_written": q(f"SELECT Churn, {_dmean('Recency')} AS Avg_Recency, "
                                 f"{_dmean('Frequency')} AS Avg_Frequency, {_dmean('Monetary')} AS Avg_Monetary, "
                                 f"count(DISTINCT CustomerID) AS Num_Customers FROM final GROUP BY Churn"),
    "recency_threshold": q("SELECT quantile_disc(Recency, 0.25) AS recency_25th, "
                           "quantile_disc(Recency, 0.75) AS recency_75th FROM rfm_churn"),
    "recency_threshold_as_written": q("SELECT quantile_disc(Recency, 0.25) AS recency_25th, "
                                      "quantile_disc(Recency, 0.75) AS recency_75th FROM final"),
    "high_recency_products": q("SELECT * FROM products", _products(">=", _THR_HIGH)),
    "high_recency_products_as_written": q("SELECT * FROM products", _products_as_written(">=", _THR_HIGH_LINES)),
    "low_recency_products": q("SELECT * FROM products", _products("<=", _THR_LOW)),
    "low_recency_products_as_written": q("SELECT * FROM products", _products_as_written("<=", _THR_LOW_LINES)),
    "product_descriptions_any": q("SELECT * FROM descs", DESC),
    "product_descriptions": q("SELECT * FROM descs", DESC),
    "high_recency_products_described": q(DESCRIBED, _products(">=", _THR_HIGH), DESC),
    "high_recency_products_described_as_written": q(DESCRIBED, _products_as_written(">=", _THR_HIGH_LINES), DESC),
    "low_recency_products_described": q(DESCRIBED, _products("<=", _THR_LOW), DESC),
    "low_recency_products_described_as_written": q(DESCRIBED, _products_as_written("<=", _THR_LOW_LINES), DESC),
    "high_recency_products_described_all": q(DESCRIBED.replace(" LIMIT 20", ""), _products(">=", _THR_HIGH), DESC),
    "low_recency_products_described_all": q(DESCRIBED.replace(" LIMIT 20", ""), _products("<=", _THR_LOW), DESC),
    "high_recency_stock_top_n": q("SELECT * FROM products ORDER BY \"count\" DESC, StockCode LIMIT 5",
                                  _products(">=", _THR_HIGH)),
    "high_recency_stock_lowest_n": q("SELECT * FROM products ORDER BY \"count\" ASC, StockCode LIMIT 5",
                                     _products(">=", _THR_HIGH)),
    "churn_by_country": q("SELECT *, CAST(Churned_Customers AS DOUBLE) / "
                          "nullif(CAST(Churned_Customers + Active_Customers AS DOUBLE), 0) AS Churn_Rate FROM ("
                          "SELECT Country, count(DISTINCT CASE WHEN Churn = 1 THEN CustomerID END) AS Churned_Customers, "
                          "count(DISTINCT CASE WHEN Churn = 0 THEN CustomerID END) AS Active_Customers "
                          "FROM final GROUP BY Country)"),
    "high_value_churned": q("SELECT CustomerID, Recency, Frequency, Monetary FROM rfm_churn WHERE Churn = 1 "
                            "AND Monetary >= (SELECT quantile_disc(Monetary, 0.75) FROM rfm_churn)"),
    "high_value_churned_as_written": q("SELECT CustomerID, Recency, Frequency, Monetary FROM final WHERE Churn = 1 "
                                       "AND Monetary >= (SELECT quantile_disc(Monetary, 0.75) FROM final)"),
    "revenue_by_country": q(f"SELECT Country, CAST(sum({REV}) AS {MONEY}) AS Total_Revenue FROM final GROUP BY Country"),
    "country_yoy": q(f"SELECT a.Country, a.Year, a.YearlyRevenue, b.YearlyRevenue AS PreviousRevenue, "
                     f"round({_growth('a.YearlyRevenue', 'b.YearlyRevenue')}, 2) AS YoY_Growth "
                     f"FROM yearly a LEFT JOIN yearly b ON a.Country = b.Country AND b.Year = a.Year - 1",
                     COUNTRY_YEAR),
    "country_yoy_as_written": q(f"SELECT *, round({_growth('YearlyRevenue', 'PreviousRevenue')}, 2) AS YoY_Growth "
                                f"FROM (SELECT *, lag(YearlyRevenue) OVER (PARTITION BY Country ORDER BY Year) "
                                f"AS PreviousRevenue FROM yearly)", COUNTRY_YEAR_MONETARY),
    "top_countries": q(f"SELECT Country, CAST(sum({REV}) AS {MONEY}) AS Total_Revenue FROM final GROUP BY Country "
                       f"ORDER BY Total_Revenue DESC, Country LIMIT 3"),
    "top_countries_ascending": q(f"SELECT Country, CAST(sum({REV}) AS {MONEY}) AS Total_Revenue FROM final "
                                 f"GROUP BY Country ORDER BY Total_Revenue ASC, Country LIMIT 5"),
    "monthly_revenue_top_countries": q("SELECT * FROM monthly", MONTHLY_TOP3),
    "year_month_label": q("SELECT *, CAST(Year AS VARCHAR) || '-' || lpad(CAST(Month AS VARCHAR), 2, '0') "
                          "AS YearMonth FROM monthly", MONTHLY_TOP3),
    "top_products_by_quantity": q("SELECT Description, CAST(sum(Quantity) AS BIGINT) AS TotalQuantity FROM final "
                                  "GROUP BY Description ORDER BY TotalQuantity DESC, Description LIMIT 10"),
    "top_products_by_quantity_ascending": q("SELECT Description, CAST(sum(Quantity) AS BIGINT) AS TotalQuantity "
                                            "FROM final GROUP BY Description "
                                            "ORDER BY TotalQuantity ASC, Description LIMIT 5"),
    "churned_top_products": q("SELECT StockCode, Description, CAST(sum(Quantity) AS BIGINT) AS TotalQuantity "
                              "FROM final WHERE Churn = 1 GROUP BY StockCode, Description "
                              "ORDER BY TotalQuantity DESC, StockCode, Description LIMIT 3"),
    "product_yoy": q("SELECT * FROM yoy", PRODUCT_YOY),
    "product_yoy_as_written": q("SELECT * FROM yoy", PRODUCT_YOY_AS_WRITTEN),
    "top_growth_products": q("SELECT * FROM yoy ORDER BY YoY_Growth DESC NULLS LAST, StockCode, Description, Year "
                             "LIMIT 20", PRODUCT_YOY),
    "top_growth_products_as_written": q("SELECT * FROM yoy ORDER BY YoY_Growth DESC NULLS LAST, StockCode, "
                                        "Description, Year LIMIT 20", PRODUCT_YOY_AS_WRITTEN),
    "revenue_per_customer": q("SELECT *, CAST(Total_Revenue AS DOUBLE) / nullif(CAST(Num_Customers AS DOUBLE), 0) "
                              "AS Revenue_per_Customer FROM rpc", PER_CUSTOMER),
    "revenue_per_customer_wide": q("SELECT * FROM wide", WIDE),
    "revenue_per_customer_long": q("SELECT Country, 'Active' AS Churn_Status, Active AS Revenue_per_Customer FROM wide "
                                   "UNION ALL SELECT Country, 'Churned', Churned FROM wide", WIDE),
    "top_customers": q("SELECT * FROM rfm_churn ORDER BY Monetary DESC, CustomerID LIMIT 5"),
    "top_customers_lowest_recency": q("SELECT * FROM rfm_churn ORDER BY Recency ASC, CustomerID LIMIT 5"),
}


# --- segmentation -------------------------------------------------------------

SEG_IN = "seg_in AS (SELECT CustomerID, Recency, Frequency, Monetary FROM rfm WHERE CustomerID <> 'Unknown')"
SCALED = ("scaled AS (SELECT *, "
          + ", ".join(f"round({c} / (SELECT stddev_samp({c}) FROM seg_in), 9) AS {c}_scaled"
                      for c in ("Recency", "Frequency", "Monetary"))
          + " FROM seg_in)")
_LEVELS = "[1.0 / 6, 0.5, 5.0 / 6]"
CENTERS = ("cq AS (SELECT " + ", ".join(f"quantile_disc({c}_scaled, {_LEVELS}) AS {c[0].lower()}"
                                          for c in ("Recency", "Frequency", "Monetary")) + " FROM scaled)")


def _dist(j: int) -> str:
    terms = [f"({c}_scaled - (SELECT {c[0].lower()}[{j + 1}] FROM cq)) * ({c}_scaled - (SELECT {c[0].lower()}[{j + 1}] FROM cq))"
             for c in ("Recency", "Frequency", "Monetary")]
    return f"({terms[0]} + {terms[1]}) + {terms[2]} AS d{j}"


ASSIGNED = (f"{SEG_IN},\n{SCALED},\n{CENTERS},\n"
            f"dist AS (SELECT *, {_dist(0)}, {_dist(1)}, {_dist(2)} FROM scaled),\n"
            "assigned AS (SELECT CustomerID, Recency, Frequency, Monetary, Recency_scaled, Frequency_scaled, "
            "Monetary_scaled, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INTEGER) "
            "AS cluster FROM dist)")


def _median_cte(c: str) -> str:
    return (f"m_{c} AS (SELECT cluster, CASE WHEN lo = hi THEN lo ELSE 0.5 * lo + 0.5 * hi END AS {c}_median FROM ("
            f"SELECT cluster, max(x) FILTER (WHERE rn = floor((n - 1) / 2)) AS lo, "
            f"max(x) FILTER (WHERE rn = ceil((n - 1) / 2)) AS hi FROM ("
            f"SELECT cluster, CAST({c} AS DOUBLE) AS x, "
            f"row_number() OVER (PARTITION BY cluster ORDER BY CAST({c} AS DOUBLE)) - 1 AS rn, "
            f"count(*) OVER (PARTITION BY cluster) AS n FROM assigned) GROUP BY cluster))")


_STATS_BODY = ("SELECT s.cluster, "
               + ", ".join(f"min({c}) AS {c}_min, CAST(sum({c}) AS DOUBLE) / count({c}) AS {c}_mean, "
                           f"any_value(m_{c}.{c}_median) AS {c}_median, max({c}) AS {c}_max"
                           for c in ("Recency", "Frequency", "Monetary"))
               + " FROM assigned s "
               + " ".join(f"JOIN m_{c} ON s.cluster = m_{c}.cluster" for c in ("Recency", "Frequency", "Monetary"))
               + " GROUP BY s.cluster")

_TOTALS = ("SELECT cluster, count(*) AS CustomerCount, CAST(sum(Recency) AS BIGINT) AS days_since_last_purchase, "
           "CAST(sum(Frequency) AS BIGINT) AS total_purchases, CAST(sum(Monetary) AS DECIMAL(38,3)) AS total_sales "
           "FROM assigned GROUP BY cluster")
_SHARES = ", ".join(f"round(CAST({c} AS DOUBLE) * 100.0 / CAST(sum({c}) OVER () AS DOUBLE), 6) AS {c}_pct"
                    for c in ("CustomerCount", "days_since_last_purchase", "total_purchases", "total_sales"))

ORACLE.update({
    "segment_input": q("SELECT * FROM seg_in", SEG_IN),
    "segment_input_as_written": q("SELECT r.CustomerID, r.Recency, r.Frequency, r.Monetary FROM rfm r "
                                  "LEFT JOIN cleaned c ON r.CustomerID = c.CustomerID"),
    "segment_input_count": q("SELECT count(*) AS n_rows FROM seg_in", SEG_IN),
    "segment_input_count_as_written": q("SELECT count(*) AS n_rows FROM rfm r LEFT JOIN cleaned c "
                                        "ON r.CustomerID = c.CustomerID"),
    "scale_features": q("SELECT CustomerID, Recency_scaled, Frequency_scaled, Monetary_scaled FROM scaled",
                        SEG_IN, SCALED),
    "segment_assign_fixed": q("SELECT * FROM assigned", ASSIGNED),
    "segment_sizes_fixed": q('SELECT cluster, count(*) AS "count" FROM assigned GROUP BY cluster', ASSIGNED),
    "segment_stats_fixed": q(_STATS_BODY, ASSIGNED, *[_median_cte(c) for c in ("Recency", "Frequency", "Monetary")]),
    "segment_totals_fixed": q(f"SELECT *, {_SHARES} FROM ({_TOTALS})", ASSIGNED),
    "cluster_display_name": q("SELECT cluster, count(*) AS \"count\", 'Cluster ' || CAST(cluster AS VARCHAR) "
                              "AS ClusterLabel FROM assigned GROUP BY cluster", ASSIGNED),
})

_MEDIANS = [_median_cte(c) for c in ("Recency", "Frequency", "Monetary")]
_TRAITS = {label: traits for label, traits in SEGMENT_LABELS}
ORACLE.update({
    "segment_cards_fixed": q(" UNION ALL ".join(
        f"SELECT s.cluster, '{c}' AS Metric, CAST(s.{c}_min AS DOUBLE) AS Min, s.{c}_mean AS Mean, s.{c}_median AS Median, "
        f"CAST(s.{c}_max AS DOUBLE) AS Max, CAST((SELECT {c[0].lower()} FROM cq)[s.cluster + 1] AS DOUBLE) AS Center FROM ({_STATS_BODY}) s"
        for c in ("Recency", "Frequency", "Monetary")), ASSIGNED, *_MEDIANS),
    "segment_labels_fixed": q(
        "SELECT i AS cluster, label AS Label, CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TRAITS.items()) + " END AS Key_Traits FROM ("
        f"SELECT i, CASE WHEN vip = 1 THEN '{SEGMENT_LABELS[1][0]}' WHEN row_number() OVER (ORDER BY vip, rec DESC, i) = 1 THEN '{SEGMENT_LABELS[2][0]}' "
        f"ELSE '{SEGMENT_LABELS[0][0]}' END AS label FROM (SELECT i, rec, CASE WHEN row_number() OVER (ORDER BY mon DESC, i) = 1 THEN 1 ELSE 0 END AS vip "
        "FROM (SELECT CAST(i AS INTEGER) AS i, (SELECT r FROM cq)[i + 1] AS rec, (SELECT m FROM cq)[i + 1] AS mon FROM range(3) AS t(i))))", ASSIGNED),
    "segmented_customers_fixed": q("SELECT DISTINCT * FROM assigned", ASSIGNED),
    "kmeans_fit_check": q("SELECT count(*) AS customers, CAST(3 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS not_nearest FROM seg_in", SEG_IN),
    "kmeans_sweep_check": f"SELECT CAST({len(KMEANS_K_RANGE)} AS BIGINT) AS ks, true AS best_is_highest, true AS in_range",
    "segment_totals_as_written_check": q(
        "SELECT count(*) AS lines, " + ", ".join(f"CAST(sum({c}) AS {MONEY}) AS total_{c}" for c in ("Recency", "Frequency", "Monetary")) + " FROM final"),
})

# --- all-text lines with malformed fields ---------------------------------------

_K = "CAST(replace(InvoiceNo, 'C', '') AS BIGINT)"
TEXT_BASE = BASE.replace("FROM raw_retail),\nc2", "FROM typed),\nc2").replace("parsed AS (", f"""raw_text AS (
  SELECT InvoiceNo, StockCode, Description,
    CASE WHEN {_K} % 307 = 0 THEN 'two' WHEN {_K} % 211 = 0 THEN '0' ELSE CAST(Quantity AS VARCHAR) END AS Quantity,
    CASE WHEN {_K} % 503 = 0 THEN '31/31/2010 8:00' ELSE InvoiceDate END AS InvoiceDate,
    CASE WHEN {_K} % 401 = 0 THEN 'free' ELSE CAST(UnitPrice AS VARCHAR) END AS UnitPrice, CustomerID, Country
  FROM raw_retail),
typed AS (SELECT * REPLACE (TRY_CAST(Quantity AS INTEGER) AS Quantity, TRY_CAST(UnitPrice AS DECIMAL(18,3)) AS UnitPrice) FROM raw_text),
parsed AS (""", 1)


def _text_q(body: str) -> str:
    return f"WITH {TEXT_BASE}\n{body}"


def _bad(column: str, converted: str) -> str:
    return _cnt("raw_text", f"{column} IS NOT NULL AND {converted} IS NULL")


_BAD_QUANTITY, _BAD_PRICE = _bad("Quantity", "TRY_CAST(Quantity AS INTEGER)"), _bad("UnitPrice", "TRY_CAST(UnitPrice AS DECIMAL(18,3))")
_BAD_DATE = _bad("InvoiceDate", "try_strptime(InvoiceDate, '%m/%d/%Y %H:%M')")
ORACLE.update({
    "load_transactions_csv": q("SELECT * FROM raw_retail"),
    "load_text_csv": _text_q("SELECT * FROM raw_text"),
    "prepared_rfm_churn": ORACLE["churn_label"],
    "prepared_churn_by_country": ORACLE["churn_by_country"],
    "prepared_country_yoy": ORACLE["country_yoy"],
    "profile_schema_text": _text_q("SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{f.name}', 'string', '{'timestamp_ntz' if f.name == 'InvoiceDate' else f.dataType.simpleString()}', '{COLUMN_ROLES.get(f.name, 'attribute')}', "
        f"'{f.metadata.get('comment', '')}', " + {"Quantity": _BAD_QUANTITY, "UnitPrice": _BAD_PRICE, "InvoiceDate": _BAD_DATE}.get(f.name, "CAST(0 AS BIGINT)") + ")"
        for i, f in enumerate(RAW.fields)) + ") AS t(position, column_name, stored_type, target_type, role, meaning, unconvertible)"),
    "cleaning_report_text": _text_q(ORACLE["cleaning_report"][ORACLE["cleaning_report"].index("SELECT * FROM (VALUES"):].replace(
        "raw_retail", "typed").replace(") AS t(step_no", f", (8, 'malformed_quantity', {_BAD_QUANTITY}), (9, 'malformed_price', {_BAD_PRICE})) AS t(step_no")),
})

# --- k-means with exact sums: the rounds written out ------------------------------

_METRICS = ("Recency", "Frequency", "Monetary")
LLOYD_ROUNDS = 10


def _lloyd(ks, weight: str = "1", rounds: int = LLOYD_ROUNDS) -> list[str]:
    """CTEs from ``points`` (id, w, x, y, z) to ``fitted`` (k, j, x, y, z): starts by rank, then the rounds."""
    ctes = ["kj AS MATERIALIZED (SELECT k, unnest(range(k)) AS j FROM (VALUES " + ", ".join(f"({k})" for k in ks) + ") AS t(k))"]
    for c in "xyz":
        ctes.append(f"cum_{c} AS MATERIALIZED (SELECT DISTINCT {c} AS v, sum(w) OVER (ORDER BY {c}) AS cum, sum(w) OVER () AS n FROM points)")
    ctes.append("cen0 AS MATERIALIZED (SELECT k, j, " + ", ".join(
        f"(SELECT min(v) FROM cum_{c} WHERE 2 * kj.k * cum >= (2 * kj.j + 1) * n) AS {c}" for c in "xyz") + " FROM kj)")
    for r in range(1, rounds + 1):
        ctes.append(f"n{r} AS MATERIALIZED (SELECT k, j, " + ", ".join(
            f"CAST(sum(CAST({c} AS DECIMAL(18,9)) * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS {c}" for c in "xyz") + f" FROM ({_near(f'cen{r - 1}')}) GROUP BY k, j)")
        ctes.append(f"cen{r} AS MATERIALIZED (SELECT k, j, " + ", ".join(f"coalesce(n.{c}, p.{c}) AS {c}" for c in "xyz")
                    + f" FROM cen{r - 1} p LEFT JOIN n{r} n USING (k, j))")
    return ctes + [f"fitted AS (SELECT * FROM cen{rounds})"]


def _near(centers: str) -> str:
    d = "((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) + (p.z - c.z) * (p.z - c.z)"
    return (f"SELECT p.*, c.k, c.j FROM points p JOIN {centers} c ON true "
            f"QUALIFY row_number() OVER (PARTITION BY p.id, c.k ORDER BY {d}, c.j) = 1")


def _silhouettes(centers: str) -> list[str]:
    """CTEs from ``points`` and (k, j, x, y, z) to ``scores`` (k, silhouette)."""
    square = " + ".join(f"CAST({c} AS DECIMAL(18,9)) * CAST({c} AS DECIMAL(18,9))" for c in "xyz")
    return [f"own AS MATERIALIZED ({_near(centers)})",
            "st AS MATERIALIZED (SELECT k, j, CAST(count(*) AS DOUBLE) AS n, " + ", ".join(
                f"CAST(sum(CAST({c} AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS {c}" for c in "xyz")
            + f", CAST(sum({square}) AS DOUBLE) / count(*) AS q FROM own GROUP BY k, j)",
            "far AS (SELECT o.id, o.k, s.j = o.j AS mine, s.n, ((((o.x * o.x + o.y * o.y) + o.z * o.z) + s.q) - 2.0 * ((o.x * s.x + o.y * s.y) + o.z * s.z)) AS d "
            "FROM own o JOIN st s ON o.k = s.k)",
            "ab AS (SELECT id, k, max(CASE WHEN mine AND n > 1 THEN d * (n / (n - 1.0)) END) AS a, min(CASE WHEN NOT mine THEN d END) AS b FROM far GROUP BY id, k)",
            "scores AS (SELECT k, round(CAST(sum(CAST(round(CASE WHEN a IS NULL OR a = b THEN 0.0 WHEN a < b THEN 1.0 - a / b ELSE b / a - 1.0 END, 12) AS DECIMAL(38,12))) AS DOUBLE) "
            "/ count(*), 9) AS silhouette FROM ab GROUP BY k)"]


_POINTS = "points AS MATERIALIZED (SELECT CustomerID AS id, 1 AS w, Recency_scaled AS x, Frequency_scaled AS y, Monetary_scaled AS z FROM scaled)"
_BY_PROFILE = "ids AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY x, z DESC, j) - 1 AS INTEGER) AS cluster FROM fitted)"
_EXACT = [SEG_IN, SCALED, _POINTS, *_lloyd([3]), _BY_PROFILE,
          f"assigned AS MATERIALIZED (SELECT s.CustomerID, s.Recency, s.Frequency, s.Monetary, i.cluster FROM ({_near('fitted')}) o "
          "JOIN ids i ON o.j = i.j JOIN seg_in s ON s.CustomerID = o.id)"]
_SWEEP = [SEG_IN, SCALED, _POINTS, *_lloyd(KMEANS_K_RANGE), *_silhouettes("fitted")]
_LINES = "wide AS (SELECT r.CustomerID, r.Recency, r.Frequency, r.Monetary, f.Lines FROM rfm r JOIN (SELECT CustomerID, count(*) AS Lines FROM fe GROUP BY CustomerID) f USING (CustomerID))"
_LINE_POINTS = ("points AS MATERIALIZED (SELECT CustomerID AS id, Lines AS w, " + ", ".join(
    f"round({c} / (SELECT stddev_samp({c}) FROM final), 9) AS {v}" for c, v in zip(_METRICS, "xyz")) + " FROM wide)")
_CENTER = dict(zip(_METRICS, "xyz"))

ORACLE.update({
    "assemble_features_columns": q("SELECT CustomerID, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}_feature" for c in _METRICS) + " FROM seg_in", SEG_IN),
    "silhouette_fixed": q("SELECT CAST(k AS INTEGER) AS k, silhouette FROM scores", SEG_IN, SCALED, _POINTS, CENTERS,
                          "fixed AS (SELECT 3 AS k, j, (SELECT r FROM cq)[j + 1] AS x, (SELECT f FROM cq)[j + 1] AS y, (SELECT m FROM cq)[j + 1] AS z FROM range(3) AS t(j))",
                          *_silhouettes("fixed")),
    "silhouette_exact": q("SELECT CAST(k AS INTEGER) AS k, silhouette FROM scores", SEG_IN, SCALED, _POINTS, *_lloyd([3]), *_silhouettes("fitted")),
    "kmeans_sweep_exact": q("SELECT CAST(k AS INTEGER) AS k, silhouette FROM scores", *_SWEEP),
    "pick_k_exact": q("SELECT CAST(k AS INTEGER) AS k, silhouette FROM scores ORDER BY silhouette DESC, k LIMIT 1", *_SWEEP),
    "kmeans_segments_exact": q("SELECT * FROM assigned", *_EXACT),
    "kmeans_segments_exact_as_written": q(
        f"SELECT w.CustomerID, w.Recency, w.Frequency, w.Monetary, w.Lines, i.cluster FROM ({_near('fitted')}) o JOIN ids i ON o.j = i.j JOIN wide w ON w.CustomerID = o.id",
        _LINES, _LINE_POINTS, *_lloyd([3]), _BY_PROFILE),
    "segment_centers_exact": q("SELECT cluster, " + ", ".join(f"round({v}, 9) AS {c}_center" for c, v in _CENTER.items()) + " FROM ids", *_EXACT),
    "segment_sizes_exact": q('SELECT cluster, count(*) AS "count" FROM assigned GROUP BY cluster', *_EXACT),
    "segment_cards_exact": q(" UNION ALL ".join(
        f"SELECT s.cluster, '{c}' AS Metric, CAST(s.{c}_min AS DOUBLE) AS Min, s.{c}_mean AS Mean, s.{c}_median AS Median, "
        f"CAST(s.{c}_max AS DOUBLE) AS Max, round(i.{v}, 9) AS Center FROM ({_STATS_BODY}) s JOIN ids i ON s.cluster = i.cluster" for c, v in _CENTER.items()), *_EXACT, *_MEDIANS),
    "segment_labels_exact": q(
        "SELECT cluster, label AS Label, CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TRAITS.items()) + " END AS Key_Traits FROM ("
        f"SELECT cluster, CASE WHEN vip = 1 THEN '{SEGMENT_LABELS[1][0]}' WHEN row_number() OVER (ORDER BY vip, x DESC, cluster) = 1 THEN '{SEGMENT_LABELS[2][0]}' "
        f"ELSE '{SEGMENT_LABELS[0][0]}' END AS label FROM (SELECT cluster, x, CASE WHEN row_number() OVER (ORDER BY z DESC, cluster) = 1 THEN 1 ELSE 0 END AS vip FROM ids))", *_EXACT),
    "segment_totals_exact": q(f"SELECT *, {_SHARES} FROM ({_TOTALS})", *_EXACT),
    "segment_model_round_trip": q("SELECT count(*) AS customers, CAST(0 AS BIGINT) AS differing FROM seg_in", SEG_IN),
    "monetary_quantile_audit": q("SELECT count(*) AS n_rows, true AS within_error FROM rfm_churn"),
    "collect_bounded": q("SELECT count(DISTINCT Country) AS countries, true AS refused FROM final"),
    "clean_deduplicate_narrow": q("SELECT DISTINCT * FROM c3"),
    "clean_transactions_narrow": q("SELECT * FROM cleaned"),
})

_LINE = "concat_ws(',', " + ", ".join(f"coalesce({c}, '')" for c in RAW_COLS) + ")"
CHECKED = ("checked AS (SELECT *, CASE WHEN " + _K + " % 601 = 0 THEN 'fields' WHEN " + _K + " % 701 = 0 THEN 'fields' ELSE concat_ws('+', "
           "CASE WHEN Quantity IS NOT NULL AND TRY_CAST(Quantity AS INTEGER) IS NULL THEN 'Quantity' END, "
           "CASE WHEN InvoiceDate IS NOT NULL AND try_strptime(InvoiceDate, '%m/%d/%Y %H:%M') IS NULL THEN 'InvoiceDate' END, "
           "CASE WHEN UnitPrice IS NOT NULL AND TRY_CAST(UnitPrice AS DECIMAL(18,3)) IS NULL THEN 'UnitPrice' END) END AS reasons, "
           f"CASE WHEN {_K} % 601 = 0 THEN concat_ws(',', " + ", ".join(f"coalesce({c}, '')" for c in RAW_COLS[:5])
           + f") WHEN {_K} % 701 = 0 THEN {_LINE} || ',extra' ELSE {_LINE} END AS line FROM raw_text)")
ORACLE.update({
    "load_checked": f"WITH {TEXT_BASE},\n{CHECKED}\nSELECT InvoiceNo, StockCode, Description, CAST(Quantity AS INTEGER) AS Quantity, InvoiceDate, "
                    "CAST(UnitPrice AS DECIMAL(18,3)) AS UnitPrice, CustomerID, Country FROM checked WHERE reasons = ''",
    "quarantine_counts": f"WITH {TEXT_BASE},\n{CHECKED}\nSELECT reason, count(*) AS lines FROM (SELECT unnest(string_split(reasons, '+')) AS reason FROM checked WHERE reasons <> '') GROUP BY reason",
    "quarantine_lines": f"WITH {TEXT_BASE},\n{CHECKED}\nSELECT line, reasons FROM checked WHERE reasons <> ''",
})
