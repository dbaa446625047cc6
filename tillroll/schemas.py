"""Declared schemas and the fixed values the analysis depends on.

Every table is read with a declared ``StructType`` (no ``inferSchema`` pass).
Money is exact: ``DecimalType(18, 3)`` per unit price, ``DecimalType(38, 3)``
for any sum of money, so totals agree to the cent across engines and do not
overflow at very large row counts.
"""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 3)
MONEY = T.DecimalType(38, 3)

# --- Fixed values that results depend on (must stay exactly as written) ----
# Text layout of InvoiceDate in the raw transaction file.
INVOICE_DATE_FORMAT = "M/d/yyyy H:mm"
# StockCodes that are not products (postage, fees, manual lines, vouchers).
EXCLUDED_STOCKCODES = (
    "POST", "DOT", "M", "C2", "BANK CHARGES", "S", "B", "AMAZONFEE",
    "gift_0001_10", "gift_0001_20", "gift_0001_30", "gift_0001_40", "gift_0001_50",
)
# Churn rule: Recency above this many days and Frequency at most this many invoices.
CHURN_RECENCY_DAYS = 95
CHURN_MAX_FREQUENCY = 7
# Pseudo customer that stands for lines without a CustomerID.
UNKNOWN_CUSTOMER = "Unknown"
# Prefix of cancelled invoices.
CANCEL_PREFIX = "C"
# k-means: sweep range, seed, and the chosen k.
KMEANS_K_RANGE = tuple(range(2, 10))
KMEANS_SEED = 1
KMEANS_BEST_K = 3
# Business names of the three segments, with their key traits.
SEGMENT_LABELS = (
    ("Active Medium-Value Customers", "Regular, recent, moderate to high spending"),
    ("Ultra VIP Customer", "Bought recently, frequently, and very high value"),
    ("Churned Low-Value Customers", "Long inactive, rare purchases, low value"),
)
# ---------------------------------------------------------------------------

RFM_COLUMNS = ("Recency", "Frequency", "Monetary")


def _f(name: str, dtype: T.DataType, nullable: bool, comment: str) -> T.StructField:
    return T.StructField(name, dtype, nullable, {"comment": comment})


# One row = one invoice line, as delivered (InvoiceDate still text).
RAW = T.StructType([
    _f("InvoiceNo", T.StringType(), True, "invoice id; a leading C marks a cancellation"),
    _f("StockCode", T.StringType(), True, "product id; some codes are not products"),
    _f("Description", T.StringType(), True, "product name"),
    _f("Quantity", T.IntegerType(), True, "units; negative on returns"),
    _f("InvoiceDate", T.StringType(), True, "invoice time as text M/d/yyyy H:mm"),
    _f("UnitPrice", PRICE, True, "price per unit"),
    _f("CustomerID", T.StringType(), True, "customer id; null when unknown"),
    _f("Country", T.StringType(), True, "country of the customer"),
])

# Cleaned lines: InvoiceDate parsed, no null Description / CustomerID.
CLEAN = T.StructType([
    f if f.name != "InvoiceDate" else _f("InvoiceDate", T.TimestampNTZType(), True, "invoice time")
    for f in RAW.fields
])

# Cleaned lines with the invoice day only (feature input).
FEATURES_IN = T.StructType([
    f if f.name != "InvoiceDate" else _f("InvoiceDate", T.DateType(), True, "invoice day")
    for f in RAW.fields
])

RFM = T.StructType([
    _f("CustomerID", T.StringType(), True, "customer"),
    _f("Recency", T.IntegerType(), True, "days from the last day in the data to the customer's last day"),
    _f("Frequency", T.LongType(), False, "distinct invoices"),
    _f("Monetary", MONEY, True, "sum of Quantity * UnitPrice"),
])

RFM_CHURN = T.StructType(RFM.fields + [_f("Churn", T.IntegerType(), False, "1 churned, 0 active")])

# Role of each raw column in the data dictionary.
COLUMN_ROLES = {
    "InvoiceNo": "identifier",
    "StockCode": "identifier",
    "Description": "attribute",
    "Quantity": "measure",
    "InvoiceDate": "time",
    "UnitPrice": "measure",
    "CustomerID": "identifier",
    "Country": "attribute",
}
