"""Adapters that present the star-schema test tables as retail invoice lines.

``retail``      already valid lines (invoice = order, line = lineitem,
                product = part, customer = customer, country = nation).
``raw_retail``  the same lines made dirty by fixed, key-driven rules so every
                cleaning step has work to do. No row is dropped; a few are
                repeated (``explode`` of a two-element array, so the joins run
                once rather than twice as a ``union`` would).

Join order is written for size: orders ⋈ customer ⋈ nation first (order
grain, a quarter of the line count), then lineitem on the order key, then
part. The strategy for each join (broadcast vs sort-merge, skew splits) is
left to AQE, which checks the runtime size of each side against
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schemas import INVOICE_DATE_FORMAT, PRICE

# --- Fixed values: the dirt rules of the raw adapter -----------------------
CANCEL_EVERY_ORDER = 25        # returned lines of every 25th order are cancellations
POST_CODE_PART = (250, 3)      # part key % 250 == 3  -> StockCode POST
MANUAL_CODE_PART = (250, 4)    # part key % 250 == 4  -> StockCode M
NO_DESCRIPTION_PART = (300, 7)  # part key % 300 == 7 -> Description null
NEGATIVE_ONE_LINE = 211        # (order + line) % 211 == 0 -> Quantity -1
ZERO_PRICE_LINE = 199          # (order + line) % 199 == 0 -> UnitPrice 0
NEGATIVE_PRICE_LINE = 997      # (order + line) % 997 == 0 -> UnitPrice negated
NO_CUSTOMER_ORDER = 4          # every 4th order has no CustomerID
REPEATED_ORDER = (100, 1)      # order key % 100 == 1 -> whole line delivered twice
# ---------------------------------------------------------------------------


# Declared read schemas (only the columns used): no footer inference per read,
# and the parquet reader fetches just these columns.
TABLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                "l_returnflag string",
}


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return df if list(cols) == df.columns else df.select(*cols)


def star_lines(spark: SparkSession, sf_dir: str, order_date: Column | None = None) -> DataFrame:
    """Line-grain join of the five tables, only the columns the adapters use; ``order_date``: what
    stands for o_orderdate, worked out once an order, not once a line."""
    nation = _table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    part = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    lineitem = _table(spark, sf_dir, "lineitem",
                      "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    invoices = (orders
                .join(customer, orders.o_custkey == customer.c_custkey)
                .join(nation, customer.c_nationkey == nation.n_nationkey)
                .select("o_orderkey", (F.col("o_orderdate") if order_date is None else order_date).alias("o_orderdate"), "c_custkey", "n_name"))
    return (lineitem
            .join(invoices, lineitem.l_orderkey == invoices.o_orderkey)
            .join(part, lineitem.l_partkey == part.p_partkey)
            .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag",
                    "o_orderdate", "c_custkey", "n_name", "p_name", "p_retailprice"))


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the table, from the counts that its files carry."""
    return _table(spark, sf_dir, "lineitem").count()


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid invoice lines with InvoiceDate already a timestamp."""
    s = star_lines(spark, sf_dir)
    return s.select(
        F.col("l_orderkey").cast("string").alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("InvoiceDate"),
        F.col("p_retailprice").cast(PRICE).alias("UnitPrice"),
        F.col("c_custkey").cast("string").alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )


def raw_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty invoice lines in the RAW layout (InvoiceDate as text).

    The projection is written as SQL expressions: one parse per column instead
    of one JVM round trip per expression node while the plan is built.
    """
    s = star_lines(spark, sf_dir, F.date_format("o_orderdate", INVOICE_DATE_FORMAT))
    cancelled = f"(l_returnflag = 'R' AND l_orderkey % {CANCEL_EVERY_ORDER} = 0)"
    kl = "(l_orderkey + l_linenumber)"
    price = f"CAST(p_retailprice AS {PRICE.simpleString()})"
    rep_mod, rep_rem = REPEATED_ORDER
    return s.selectExpr(
        f"CASE WHEN {cancelled} THEN concat('C', CAST(l_orderkey AS STRING)) "
        f"ELSE CAST(l_orderkey AS STRING) END AS InvoiceNo",
        f"CASE WHEN l_partkey % {POST_CODE_PART[0]} = {POST_CODE_PART[1]} THEN 'POST' "
        f"WHEN l_partkey % {MANUAL_CODE_PART[0]} = {MANUAL_CODE_PART[1]} THEN 'M' "
        f"ELSE CAST(l_partkey AS STRING) END AS StockCode",
        f"CASE WHEN l_partkey % {NO_DESCRIPTION_PART[0]} = {NO_DESCRIPTION_PART[1]} THEN CAST(NULL AS STRING) "
        f"ELSE p_name END AS Description",
        f"CASE WHEN {cancelled} THEN -CAST(l_quantity AS INT) "
        f"WHEN {kl} % {NEGATIVE_ONE_LINE} = 0 THEN -1 ELSE CAST(l_quantity AS INT) END AS Quantity",
        "o_orderdate AS InvoiceDate",
        f"CAST(CASE WHEN {kl} % {ZERO_PRICE_LINE} = 0 THEN CAST(0 AS {PRICE.simpleString()}) "
        f"WHEN {kl} % {NEGATIVE_PRICE_LINE} = 0 THEN -{price} ELSE {price} END "
        f"AS {PRICE.simpleString()}) AS UnitPrice",
        f"CASE WHEN l_orderkey % {NO_CUSTOMER_ORDER} = 0 THEN CAST(NULL AS STRING) "
        f"ELSE CAST(c_custkey AS STRING) END AS CustomerID",
        "n_name AS Country",
        f"explode(CASE WHEN l_orderkey % {rep_mod} = {rep_rem} THEN array(1, 2) ELSE array(1) END) AS _copy",
    ).drop("_copy")


# --- Fixed values: malformed fields of the all-text form, by invoice number ---
BAD_QUANTITY_INVOICE = (307, "two")
BAD_PRICE_INVOICE = (401, "free")
BAD_DATE_INVOICE = (503, "31/31/2010 8:00")
ZERO_QUANTITY_INVOICE = 211
# ---------------------------------------------------------------------------


def raw_text_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines with every column as text, as a file delivers them, some fields malformed."""
    k = "CAST(replace(InvoiceNo, 'C', '') AS BIGINT)"
    return raw_retail(spark, sf_dir).selectExpr(
        "InvoiceNo", "StockCode", "Description",
        f"CASE WHEN {k} % {BAD_QUANTITY_INVOICE[0]} = 0 THEN '{BAD_QUANTITY_INVOICE[1]}' "
        f"WHEN {k} % {ZERO_QUANTITY_INVOICE} = 0 THEN '0' ELSE CAST(Quantity AS STRING) END AS Quantity",
        f"CASE WHEN {k} % {BAD_DATE_INVOICE[0]} = 0 THEN '{BAD_DATE_INVOICE[1]}' ELSE InvoiceDate END AS InvoiceDate",
        f"CASE WHEN {k} % {BAD_PRICE_INVOICE[0]} = 0 THEN '{BAD_PRICE_INVOICE[1]}' ELSE CAST(UnitPrice AS STRING) END AS UnitPrice",
        "CustomerID", "Country")


# --- Fixed values: lines of the file form that lost or gained fields, by invoice number ---
SHORT_LINE_INVOICE = (601, 5)  # only the first five fields are left
LONG_LINE_INVOICE = (701, "extra")  # one more field at the end
# ---------------------------------------------------------------------------


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The all-text lines as CSV text (column ``value``), some of them cut off or too long."""
    k = F.expr("CAST(replace(InvoiceNo, 'C', '') AS BIGINT)")
    line = F.to_csv(F.struct("*"))
    lines = raw_text_retail(spark, sf_dir).select(k.alias("k"), line.alias("line"))
    short, long = k_is(SHORT_LINE_INVOICE[0]), k_is(LONG_LINE_INVOICE[0])
    return lines.select(F.when(short, F.substring_index("line", ",", SHORT_LINE_INVOICE[1]))
                        .when(long, F.concat("line", F.lit("," + LONG_LINE_INVOICE[1]))).otherwise(F.col("line")).alias("value"))


def k_is(every: int):
    return F.col("k") % every == 0
