"""Cleaning steps C1–C6 and their composition C7.

Each step is a ``DataFrame -> DataFrame`` function for ``df.transform``.
They work with ANSI mode on or off: parsing uses ``try_to_timestamp`` and the
customer id is text before it is filled.

Catalyst moves the row filters of C5/C6 below the deduplication of C4 (they
only read grouping columns), so they reach the scan and shrink the shuffles.
The dedup is an aggregate over rows shuffled once, in partitions sized by these rows
(``duplicates.distinct_rows``); all copies of a row are read by one task, which keeps one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import duplicates
from tillroll.schemas import EXCLUDED_STOCKCODES, INVOICE_DATE_FORMAT, PRICE, UNKNOWN_CUSTOMER


def parse_invoice_date(df: DataFrame, fmt: str = INVOICE_DATE_FORMAT) -> DataFrame:
    """InvoiceDate text -> timestamp_ntz; unparseable text becomes null."""
    ts = F.try_to_timestamp(F.col("InvoiceDate"), F.lit(fmt)).cast("timestamp_ntz")
    return df.withColumn("InvoiceDate", ts)


def typed(raw_text: DataFrame) -> DataFrame:
    """All-text lines with Quantity and UnitPrice as numbers; a malformed field becomes null
    (``profile.cleaning_report_text`` counts them)."""
    return (raw_text.withColumn("Quantity", F.col("Quantity").try_cast("int"))
            .withColumn("UnitPrice", F.col("UnitPrice").try_cast(PRICE)))


def drop_missing_description(df: DataFrame) -> DataFrame:
    """Drop lines without a product description."""
    return df.filter(F.col("Description").isNotNull())


def fill_customer(df: DataFrame, unknown: str = UNKNOWN_CUSTOMER) -> DataFrame:
    """Null CustomerID -> 'Unknown' (the id is text, so no cast error)."""
    return df.withColumn("CustomerID", F.coalesce(F.col("CustomerID").cast("string"), F.lit(unknown)))


def deduplicate(df: DataFrame) -> DataFrame:
    """C4: drop lines equal in every column."""
    return duplicates.distinct_rows(df)


def deduplicate_narrow(df: DataFrame) -> DataFrame:
    """C4 for wide or many lines: the same rows; only lines whose 128-bit key occurs
    twice are shuffled (see ``duplicates``), for two more reads of the lines."""
    return duplicates.deduplicate(df)


def keep_positive(df: DataFrame) -> DataFrame:
    """Keep Quantity > 0 and UnitPrice > 0 (drops cancellations, returns, zeros)."""
    return df.filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


def exclude_codes(df: DataFrame, codes: Sequence[str] = EXCLUDED_STOCKCODES) -> DataFrame:
    """Drop non-product stock codes (a null code is dropped too, as in SQL)."""
    return df.filter(~F.col("StockCode").isin(list(codes)))


STEPS = (
    ("parse_date", parse_invoice_date),
    ("drop_missing_description", drop_missing_description),
    ("fill_customer", fill_customer),
    ("deduplicate", deduplicate),
    ("positive", keep_positive),
    ("exclude_codes", exclude_codes),
)


def clean_upto(df: DataFrame, step: str) -> DataFrame:
    """Apply C1.. up to and including ``step`` (in the fixed order)."""
    names = [n for n, _ in STEPS]
    if step not in names:
        raise ValueError(f"unknown step {step!r}; one of {names}")
    for name, fn in STEPS[: names.index(step) + 1]:
        df = df.transform(fn)
    return df


def clean_transactions(df: DataFrame, codes: Sequence[str] = EXCLUDED_STOCKCODES, narrow: bool = False) -> DataFrame:
    """C1 -> C6 composed; ``narrow``: with ``deduplicate_narrow``, after the row filters of C5 and C6
    (these read a line alone, so the order does not change the result)."""
    df = df.transform(parse_invoice_date).transform(drop_missing_description).transform(fill_customer)
    if narrow:
        return deduplicate_narrow(df.transform(keep_positive).transform(lambda d: exclude_codes(d, codes)))
    return df.transform(deduplicate).transform(keep_positive).transform(lambda d: exclude_codes(d, codes))
