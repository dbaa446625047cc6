"""File sources and sinks for transaction tables.

Reads always use a declared schema, so there is no inference pass over the
data and types never drift between runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schemas import INVOICE_DATE_FORMAT, RAW

# Largest result ``collect_bounded`` will bring to the driver.
DEFAULT_COLLECT_LIMIT = 10_000


def load_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType = RAW, corrupt_column: str | None = None) -> DataFrame:
    """Read raw invoice lines (header CSV by default) with a declared schema.

    A malformed CSV field becomes null (PERMISSIVE mode) rather than failing
    the job. ``corrupt_column`` keeps the whole text of such a line; ``load_checked``
    sets such lines aside with their reasons; to count malformed fields column by
    column, read with ``load_text`` and use ``profile.profile_schema`` and
    ``profile.cleaning_report_text``.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if corrupt_column:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(schema).csv(path)


def load_text(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """Read a header CSV of raw invoice lines with every declared column as text."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.schema(text).option("header", True).csv(path)


@dataclass
class CheckedLines:
    """Invoice lines of a file, parted: ``good`` with the columns of the schema, ``bad`` as
    (line, reasons), the whole line as it stood in the file and why it was set aside."""

    good: DataFrame
    bad: DataFrame

    def counts(self) -> DataFrame:
        """(reason, lines); a line counts once for each of its reasons."""
        return self.bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("lines")).orderBy("reason")

    def write_quarantine(self, path: str) -> None:
        """Write the bad lines (Parquet), to be mended and loaded again."""
        self.bad.write.mode("overwrite").parquet(path)


#: Reasons of quarantine: the number of fields, and the columns whose text does not convert.
WRONG_FIELDS = "fields"


def load_checked(spark: SparkSession, path: str, schema: T.StructType = RAW, header: bool = True,
                 date_format: str = INVOICE_DATE_FORMAT) -> CheckedLines:
    """Read CSV lines and set those aside that do not fit the schema, whole, with their reasons.

    A line is bad if it has too few or too many fields, or a field that is not null and
    does not convert to its column's type (InvoiceDate stays text but must parse). Blank
    lines and header lines are skipped. Each line is parsed where it is read, in one pass
    and without a shuffle; a quoted field cannot run over the end of a line.
    """
    names = [f.name for f in schema.fields]
    fields = ", ".join(f"`{n}` string" for n in names) + ", _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if header:
        lines = lines.filter(F.col("value") != ",".join(names))
    parsed = lines.select(F.col("value").alias("line"), F.from_csv("value", fields, options).alias("f"))

    def misfit(f: T.StructField) -> Column:
        text = F.col(f"f.{f.name}")
        kept = F.try_to_timestamp(text, F.lit(date_format)) if f.name == "InvoiceDate" else text.try_cast(f.dataType)
        return text.isNotNull() & kept.isNull()

    checks = [F.when(misfit(f), F.lit(f.name)) for f in schema.fields if f.name == "InvoiceDate" or not isinstance(f.dataType, T.StringType)]
    reasons = F.when(F.col("f._corrupt").isNotNull(), F.array(F.lit(WRONG_FIELDS))).otherwise(F.array_compact(F.array(*checks)))
    judged = parsed.withColumn("reasons", reasons)
    good = judged.filter(F.size("reasons") == 0).select(*[F.col(f"f.{f.name}").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return CheckedLines(good, judged.filter(F.size("reasons") > 0).select("line", "reasons"))


def load_prepared(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """Read a table written by ``write_prepared`` (parquet by default).

    Parquet carries its own schema; a declared one may still be given to pin it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: Sequence[str] | None = ("Year",),
                   date_col: str = "InvoiceDate") -> None:
    """Write a prepared line table, partitioned by invoice year.

    Year partitions give partition pruning to every year filter downstream
    (``PartitionFilters`` in the scan).
    The year column is derived here when absent. Pass ``partition_by=None``
    for an unpartitioned table.
    """
    out = df
    if partition_by and "Year" in partition_by and "Year" not in df.columns:
        out = out.withColumn("Year", F.year(date_col))
    # No repartition on the partition column: with a handful of years that
    # would send each year through one task. Every task writes its own files
    # for the years it holds, fully in parallel.
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows under an explicit total order (all columns by default)."""
    keys = list(order_by) if order_by else [F.col(c).asc_nulls_first() for c in df.columns]
    return df.orderBy(*keys).limit(n)


def collect_bounded(df: DataFrame, max_rows: int = DEFAULT_COLLECT_LIMIT) -> pd.DataFrame:
    """Bring a small, already aggregated result to the driver as pandas (Arrow).

    Refuses instead of truncating: at most ``max_rows + 1`` rows are ever
    fetched, and more than ``max_rows`` raises.
    """
    pdf = df.limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; aggregate or limit it in Spark first")
    return pdf
