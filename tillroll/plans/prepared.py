"""The standard derived tables, built lazily from one raw line source.

    raw ──C1..C6──▶ cleaned ──F1──▶ features_in ──F5,F7──▶ rfm_churn
                       │                 │                      │
                       └──F8 (v1)        └──────F9 (v2) = final ◀┘
    rfm ──F10 (v3)── cleaned

Lines stay a lazy plan, so column pruning and filter pushdown reach the scan
for each query separately. The per-customer rows (one for each customer) are
aggregated once per ``RetailTables`` and written to the checkpoint folder: RFM,
churn, thresholds and joins read them there, so a report reads the lines at most
twice. Reports that return whole lines keep the cleaned lines as well (``kept``): a
second pass over the raw lines would shuffle all of them again. ``from_prepared``
starts from tables that ``sources.files.write_prepared`` wrote, and reads no raw
lines at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import clean, features
from tillroll.schemas import UNKNOWN_CUSTOMER
from tillroll.session import ensure_checkpoint_dir, release_shuffles, written
from tillroll.sources import files, testdata

#: Kept lines are cleaned in parts of about so many raw lines, but in at most so many parts: each part reads
#: the raw tables again, and with three the shuffles of one part take no more disk than the reports' own join.
PART_LINES = 2_000_000
MAX_PARTS = 3


def in_parts(raw: DataFrame, n: int) -> list[DataFrame]:
    """The lines in ``n`` parts of whole invoices, so that the copies of a line are in one part."""
    if n == 1:
        return [raw]
    return [raw.filter(F.pmod(F.xxhash64("InvoiceNo"), F.lit(n)) == i) for i in range(n)]


@dataclass
class RetailTables:
    """``size``: gives about how many raw lines there are; it steers only in how many parts they are kept."""

    raw: DataFrame | None
    prepared_lines: DataFrame | None = None
    prepared_customers: DataFrame | None = None
    size: Callable[[], int] | None = None

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "RetailTables":
        """Dirty lines over the star-schema test tables (exercises every cleaning rule)."""
        return cls(testdata.raw_retail(spark, sf_dir), size=lambda: testdata.line_count(spark, sf_dir))

    @classmethod
    def from_prepared(cls, spark: SparkSession, lines_path: str, customers_path: str) -> "RetailTables":
        """Cleaned lines and per-customer rows as ``write`` left them."""
        return cls(None, files.load_prepared(spark, lines_path).drop("Year"), files.load_prepared(spark, customers_path))

    def write(self, lines_path: str, customers_path: str) -> None:
        """Write the two prepared tables to paths that all executors share; the customers are
        made from the lines as written, so the raw lines are cleaned once."""
        files.write_prepared(self.cleaned, lines_path)
        customers = self.prepared_customers
        if customers is None:
            lines = files.load_prepared(self.cleaned.sparkSession, lines_path).drop("Year")
            customers = features.per_customer(features.to_invoice_date(lines))
        files.write_prepared(customers, customers_path, partition_by=None)

    def kept(self, *columns: str) -> "RetailTables":
        """Tables for reports that need the customers first and then the lines again: the lines, with
        these columns and those that customers are made of (all columns if none is named), are cleaned
        and written once (as Parquet in the checkpoint folder) and read there. Tables from prepared
        files stay as they are.

        Many lines are cleaned in parts: whole rows in a shuffle take several times the disk that they
        take as Parquet, and only one part's shuffles are there at a time.
        """
        if self.raw is None:
            return self
        spark = self.raw.sparkSession
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
        names = [c for c in self.cleaned.columns if not columns or c in {*features.CUSTOMER_INPUT, *columns}]
        parts = min(MAX_PARTS, max(1, -(-self.size() // PART_LINES))) if self.size else 1
        for part in in_parts(self.raw, parts):
            RetailTables(part).cleaned.select(*names).write.mode("append").parquet(path)
            if parts > 1:
                release_shuffles(spark)
        lines = files.load_prepared(spark, path)
        customers = written(features.per_customer(features.to_invoice_date(lines)))
        if parts > 1:
            release_shuffles(spark)
        return RetailTables(None, lines, customers)

    @cached_property
    def parsed(self) -> DataFrame:
        return clean.parse_invoice_date(self.raw)

    @cached_property
    def cleaned(self) -> DataFrame:
        return self.prepared_lines if self.raw is None else clean.clean_transactions(self.raw)

    @cached_property
    def features_in(self) -> DataFrame:
        return features.to_invoice_date(self.cleaned)

    @cached_property
    def customers(self) -> DataFrame:
        """Last day, Frequency, Monetary and Lines per customer, aggregated once."""
        return self.prepared_customers if self.raw is None else written(features.per_customer(self.features_in))

    def rfm(self, include_unknown: bool = True) -> DataFrame:
        out = features.rfm_of(self.customers)
        return out if include_unknown else out.filter(out.CustomerID != UNKNOWN_CUSTOMER)

    def weighted(self) -> DataFrame:
        """RFM, churn and the number of lines per customer."""
        return features.churn_label(features.rfm_of(self.customers, "Lines"))

    def rfm_churn(self, include_unknown: bool = True) -> DataFrame:
        return features.churn_label(self.rfm(include_unknown))

    @cached_property
    def final_v1(self) -> DataFrame:
        """Cleaned lines (timestamp) + Churn."""
        return features.transactions_with_churn(self.cleaned, self.rfm_churn(), self.customers)

    @cached_property
    def final(self) -> DataFrame:
        """Cleaned lines (invoice day) + Recency, Frequency, Monetary, Churn."""
        return features.transactions_with_rfm_churn(self.features_in, self.rfm_churn(), self.customers)

    @cached_property
    def final_v3(self) -> DataFrame:
        """RFM rows with their cleaned lines (no Churn)."""
        return features.rfm_with_transactions(self.rfm(), self.cleaned, self.customers)
