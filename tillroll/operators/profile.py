"""Profiling P1–P12: shape, schema, nulls, duplicates, anomalies, cleaning report.

Each profile is one aggregation pass (conditional counts side by side) instead
of one job per number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Column
from pyspark.sql import types as T

from tillroll.functions.columns import is_cancelled, null_count
from tillroll.operators import clean
from tillroll.operators.duplicates import duplicate_rows, key_counts
from tillroll.schemas import COLUMN_ROLES, EXCLUDED_STOCKCODES, INVOICE_DATE_FORMAT, PRICE, RAW


def profile_shape(df: DataFrame) -> DataFrame:
    """Number of columns and rows."""
    return df.agg(F.lit(len(df.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n_rows"))


def _unconvertible(df: DataFrame, name: str, target: T.DataType) -> Column:
    """Count of non-null values of ``name`` that do not convert to ``target``."""
    c = F.col(name)
    if name == "InvoiceDate" and isinstance(df.schema[name].dataType, T.StringType):
        bad = c.isNotNull() & F.try_to_timestamp(c, F.lit(INVOICE_DATE_FORMAT)).isNull()
    elif df.schema[name].dataType == target:
        return F.lit(0).cast("bigint")
    else:
        bad = c.isNotNull() & c.try_cast(target).isNull()
    return F.count_if(bad)


def profile_schema(df: DataFrame, target: T.StructType = RAW) -> DataFrame:
    """Per column: stored type, target type, role, meaning and the number of
    values that would not convert to the target type (one pass, then unpivot)."""
    targets = {f.name: f for f in target.fields}
    cols = [c for c in df.columns if c in targets]
    tgt_types = {c: (T.TimestampNTZType() if c == "InvoiceDate" else targets[c].dataType) for c in cols}
    counts = df.agg(*[_unconvertible(df, c, tgt_types[c]).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column_name", "unconvertible")

    def lookup(values: dict) -> Column:
        # schema-sized literal map keyed by column name (no join needed)
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[
            F.col("column_name")]

    return (long.select(
        lookup({c: i for i, c in enumerate(cols)}).alias("position"),
        "column_name",
        lookup({c: df.schema[c].dataType.simpleString() for c in cols}).alias("stored_type"),
        lookup({c: tgt_types[c].simpleString() for c in cols}).alias("target_type"),
        lookup({c: COLUMN_ROLES.get(c, "attribute") for c in cols}).alias("role"),
        lookup({c: targets[c].metadata.get("comment", "") for c in cols}).alias("meaning"),
        "unconvertible",
    ).orderBy("position"))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Nulls in every column, one pass."""
    return df.agg(*[null_count(c).alias(c) for c in df.columns])


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row = Σ (group size − 1) over equal rows,
    counted on 128-bit row keys: no whole row is shuffled."""
    return duplicate_rows(df)


def profile_cancelled(df: DataFrame) -> DataFrame:
    """P5: invoices lines whose InvoiceNo starts with C."""
    return df.agg(F.count_if(is_cancelled()).alias("cancelled_rows"))


def profile_negative_quantity(df: DataFrame) -> DataFrame:
    """Lines with Quantity < 0."""
    return df.agg(F.count_if(F.col("Quantity") < 0).alias("negative_quantity_rows"))


def profile_negative_price(df: DataFrame) -> DataFrame:
    """Lines with UnitPrice < 0."""
    return df.agg(F.count_if(F.col("UnitPrice") < 0).alias("negative_price_rows"))


def anomaly_preview(df: DataFrame, kind: str, n: int = 5) -> DataFrame:
    """First n anomalous lines (cancelled / negative_quantity / negative_price),
    in a fixed order."""
    preds = {
        "cancelled": is_cancelled(),
        "negative_quantity": F.col("Quantity") < 0,
        "negative_price": F.col("UnitPrice") < 0,
    }
    cols = {
        "cancelled": df.columns,
        "negative_quantity": ["InvoiceNo", "Quantity"],
        "negative_price": ["InvoiceNo", "UnitPrice"],
    }[kind]
    return (df.filter(preds[kind]).select(*cols)
            .orderBy(*[F.col(c).asc_nulls_first() for c in cols]).limit(n))


def stockcodes_missing_description(df: DataFrame) -> DataFrame:
    """Distinct StockCodes that have a line without Description."""
    return df.filter(F.col("Description").isNull()).select("StockCode").distinct()


def excluded_code_pairs(df: DataFrame, codes: Sequence[str] = EXCLUDED_STOCKCODES) -> DataFrame:
    """Distinct StockCode–Description pairs among the non-product codes."""
    return df.filter(F.col("StockCode").isin(list(codes))).select("StockCode", "Description").distinct()


def cleaning_report(raw: DataFrame, codes: Sequence[str] = EXCLUDED_STOCKCODES) -> DataFrame:
    """P10: rows left after each cleaning step, plus what the filters drop
    silently (zero Quantity / UnitPrice) and dates that did not parse.

    One narrow shuffle: the parsed, id-filled lines are counted by their 128-bit
    row key (that grouping is the deduplication) with what the steps ask of a line
    as flags, and every step's count is a conditional sum or count over the groups.
    """
    prepared = raw.transform(clean.parse_invoice_date).transform(clean.fill_customer)
    g = key_counts(prepared, {
        "_desc": F.col("Description").isNotNull(),
        "_positive": (F.col("Quantity") > 0) & (F.col("UnitPrice") > 0),
        "_product": ~F.col("StockCode").isin(list(codes)),
        "_no_quantity": F.col("Quantity") == 0,
        "_no_price": F.col("UnitPrice") == 0,
        "_no_date": F.col("InvoiceDate").isNull()})
    has_desc, positive, product = F.col("_desc"), F.col("_positive"), F.col("_product")
    row = g.agg(
        F.sum("_n").alias("raw"),
        F.sum(F.when(has_desc, F.col("_n"))).alias("drop_missing_description"),
        F.count_if(has_desc).alias("deduplicate"),
        F.count_if(has_desc & positive).alias("positive"),
        F.count_if(has_desc & positive & product).alias("exclude_codes"),
        F.count_if(has_desc & F.col("_no_quantity")).alias("zero_quantity_after_dedup"),
        F.count_if(has_desc & F.col("_no_price")).alias("zero_price_after_dedup"),
        F.sum(F.when(F.col("_no_date"), F.col("_n"))).alias("unparsed_dates"),
    )
    steps = ["raw", "drop_missing_description", "deduplicate", "positive", "exclude_codes",
             "zero_quantity_after_dedup", "zero_price_after_dedup", "unparsed_dates"]
    row = row.select(*[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in steps])
    order = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), F.lit(i))])
    return (row.unpivot([], steps, "step", "rows")
            .select(order[F.col("step")].alias("step_no"), "step", "rows")
            .orderBy("step_no"))


def cleaning_report_text(raw_text: DataFrame, codes: Sequence[str] = EXCLUDED_STOCKCODES) -> DataFrame:
    """P10 from all-text lines: the report over the typed lines, and how many
    Quantity and UnitPrice fields were malformed (null after typing)."""
    bad = raw_text.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(n) for c, t, n in (
        ("Quantity", "int", "malformed_quantity"), ("UnitPrice", PRICE, "malformed_price"))])
    steps = F.create_map(F.lit("malformed_quantity"), F.lit(8), F.lit("malformed_price"), F.lit(9))
    extra = bad.unpivot([], ["malformed_quantity", "malformed_price"], "step", "rows").select(steps[F.col("step")].alias("step_no"), "step", "rows")
    return cleaning_report(clean.typed(raw_text), codes).unionByName(extra).orderBy("step_no")


def latest_transaction(df: DataFrame) -> DataFrame:
    """The last invoice day in the data."""
    return df.agg(F.max(F.to_date("InvoiceDate")).alias("latest_date"))


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    """Number of rows (e.g. entering clustering)."""
    return df.agg(F.count(F.lit(1)).alias(name))
