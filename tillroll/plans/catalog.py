"""Named queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry builds one plan from the parquet scan to its result over the whole
tables. ``*_as_written`` entries reproduce the line-weighted / lag-over-present
years behaviour of the original analysis; the plain names are the corrected
forms (per-customer grain, calendar-year growth).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import analysis as A
from tillroll.operators import clean as C
from tillroll.operators import features as Fe
from tillroll.operators import profile as P
from tillroll.plans.prepared import RetailTables
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources import files, testdata

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> RetailTables:
    return RetailTables.from_testdata(spark, sf_dir)


def _on(build: Callable[[RetailTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_t(spark, sf_dir))


def _deduplicated(t: RetailTables) -> DataFrame:
    return C.clean_upto(t.raw, "deduplicate")


def _through_csv(spark: SparkSession, sf_dir: str, text: bool) -> DataFrame:
    """The raw lines written as CSV to the shared checkpoint folder and loaded from there."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}.csv"
    lines = testdata.raw_text_retail(spark, sf_dir) if text else testdata.raw_retail(spark, sf_dir)
    lines.write.option("header", True).csv(path)
    return files.load_text(spark, path) if text else files.load_transactions(spark, path)


def _checked(spark: SparkSession, sf_dir: str) -> files.CheckedLines:
    """CSV lines, some malformed, written to the shared checkpoint folder and read back with their quarantine."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}.csv"
    testdata.csv_lines(spark, sf_dir).write.text(path)
    return files.load_checked(spark, path, header=False)


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad lines, written and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarantine-{uuid.uuid4().hex}"
    _checked(spark, sf_dir).write_quarantine(path)
    return spark.read.parquet(path).select("line", F.concat_ws("+", "reasons").alias("reasons"))


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 on revenue by country: rows collected within the bound, and whether one row less is refused."""
    revenue = A.revenue_by_country(_t(spark, sf_dir).features_in)
    n = len(files.collect_bounded(revenue, 1_000))
    try:
        refused = files.collect_bounded(revenue, n - 1) is None
    except ValueError:
        refused = True
    return spark.createDataFrame([(n, refused)], "countries long, refused boolean")


def _through_prepared(spark: SparkSession, sf_dir: str) -> RetailTables:
    """Tables read back from the prepared files that ``RetailTables.write`` leaves."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prepared-{uuid.uuid4().hex}"
    _t(spark, sf_dir).write(f"{folder}/lines", f"{folder}/customers")
    return RetailTables.from_prepared(spark, f"{folder}/lines", f"{folder}/customers")


SOURCES: dict[str, Query] = {
    "load_transactions_csv": lambda s, d: _through_csv(s, d, False),
    "load_text_csv": lambda s, d: _through_csv(s, d, True),
    "prepared_rfm_churn": lambda s, d: _through_prepared(s, d).rfm_churn(),
    "prepared_churn_by_country": lambda s, d: (lambda t: A.churn_by_country(t.features_in, t.rfm_churn()))(_through_prepared(s, d)),
    "prepared_country_yoy": lambda s, d: A.country_yoy(_through_prepared(s, d).features_in),
    "load_checked": lambda s, d: _checked(s, d).good,
    "quarantine_counts": lambda s, d: _checked(s, d).counts(),
    "quarantine_lines": _quarantined,
    "collect_bounded": _bounded,
    "load_transactions": _on(lambda t: t.raw),
    "preview": _on(lambda t: files.preview(t.raw, 5)),
}

PROFILE: dict[str, Query] = {
    "profile_shape": _on(lambda t: P.profile_shape(t.raw)),
    "profile_schema": _on(lambda t: P.profile_schema(t.raw)),
    "profile_nulls": _on(lambda t: P.profile_nulls(t.parsed)),
    "profile_nulls_cleaned": _on(lambda t: P.profile_nulls(C.clean_upto(t.raw, "fill_customer"))),
    "profile_duplicates": _on(lambda t: P.profile_duplicates(C.clean_upto(t.raw, "fill_customer"))),
    "profile_cancelled": _on(lambda t: P.profile_cancelled(_deduplicated(t))),
    "profile_negative_quantity": _on(lambda t: P.profile_negative_quantity(_deduplicated(t))),
    "profile_negative_price": _on(lambda t: P.profile_negative_price(_deduplicated(t))),
    "profile_cancelled_preview": _on(lambda t: P.anomaly_preview(_deduplicated(t), "cancelled")),
    "profile_negative_quantity_preview":
        _on(lambda t: P.anomaly_preview(_deduplicated(t), "negative_quantity")),
    "profile_negative_price_preview":
        _on(lambda t: P.anomaly_preview(_deduplicated(t), "negative_price")),
    "stockcodes_missing_description": _on(lambda t: P.stockcodes_missing_description(t.parsed)),
    "stockcodes_missing_description_count":
        _on(lambda t: P.row_count(P.stockcodes_missing_description(t.parsed), "n_stockcodes")),
    "excluded_code_pairs": _on(lambda t: P.excluded_code_pairs(C.clean_upto(t.raw, "positive"))),
    "cleaning_report": _on(lambda t: P.cleaning_report(t.raw)),
    "profile_schema_text": lambda s, d: P.profile_schema(testdata.raw_text_retail(s, d)),
    "cleaning_report_text": lambda s, d: P.cleaning_report_text(testdata.raw_text_retail(s, d)),
    "latest_transaction": _on(lambda t: P.latest_transaction(t.cleaned)),
}

CLEANING: dict[str, Query] = {
    "clean_parse_date": _on(lambda t: C.clean_upto(t.raw, "parse_date")),
    "clean_drop_missing_description": _on(lambda t: C.clean_upto(t.raw, "drop_missing_description")),
    "clean_fill_customer": _on(lambda t: C.clean_upto(t.raw, "fill_customer")),
    "clean_deduplicate": _on(lambda t: C.clean_upto(t.raw, "deduplicate")),
    "clean_deduplicate_narrow": _on(lambda t: C.deduplicate_narrow(C.clean_upto(t.raw, "fill_customer"))),
    "clean_positive": _on(lambda t: C.clean_upto(t.raw, "positive")),
    "clean_exclude_codes": _on(lambda t: C.clean_upto(t.raw, "exclude_codes")),
    "clean_transactions": _on(lambda t: t.cleaned),
    "clean_transactions_narrow": _on(lambda t: C.clean_transactions(t.raw, narrow=True)),
}

FEATURES: dict[str, Query] = {
    "to_invoice_date": _on(lambda t: t.features_in),
    "rfm_recency": _on(lambda t: Fe.rfm_recency(t.features_in)),
    "rfm_frequency": _on(lambda t: Fe.rfm_frequency(t.features_in)),
    "rfm_monetary": _on(lambda t: Fe.rfm_monetary(t.features_in)),
    "rfm": _on(lambda t: t.rfm()),
    "rfm_means": _on(lambda t: Fe.rfm_means(t.rfm())),
    "churn_label": _on(lambda t: t.rfm_churn()),
    "transactions_with_churn": _on(lambda t: t.kept().final_v1),
    "transactions_with_rfm_churn": _on(lambda t: t.kept().final),
    "rfm_with_transactions": _on(lambda t: t.kept().final_v3),
}


def _recency_products(t: RetailTables, high: bool, as_written: bool) -> DataFrame:
    t = t.kept("StockCode")
    if as_written:
        return A.recency_products_as_written(t.features_in, high=high, customers=t.weighted())
    return A.recency_products(t.features_in, t.rfm_churn(), high=high)


def _described(t: RetailTables, high: bool, as_written: bool, n: int | None = 20) -> DataFrame:
    t = t.kept("StockCode", "Description")
    return A.products_described(_recency_products(t, high, as_written),
                                A.product_descriptions(t.features_in), n)


def _per_customer_wide(t: RetailTables) -> DataFrame:
    return A.revenue_per_customer_wide(A.revenue_per_customer(t.features_in, t.rfm_churn()))


ANALYSIS: dict[str, Query] = {
    "rfm_by_churn": _on(lambda t: A.rfm_by_churn(t.rfm_churn())),
    "rfm_by_churn_as_written": _on(lambda t: A.rfm_by_churn_as_written(t.weighted())),
    "recency_threshold": _on(lambda t: A.recency_threshold(t.rfm_churn())),
    "recency_threshold_as_written": _on(lambda t: A.recency_threshold(t.weighted(), "Lines")),
    "high_recency_products": _on(lambda t: _recency_products(t, True, False)),
    "high_recency_products_as_written": _on(lambda t: _recency_products(t, True, True)),
    "low_recency_products": _on(lambda t: _recency_products(t, False, False)),
    "low_recency_products_as_written": _on(lambda t: _recency_products(t, False, True)),
    "product_descriptions_any": _on(lambda t: A.product_descriptions(t.features_in)),
    "product_descriptions": _on(lambda t: A.product_descriptions(t.features_in)),
    "high_recency_products_described": _on(lambda t: _described(t, True, False)),
    "high_recency_products_described_as_written": _on(lambda t: _described(t, True, True)),
    "low_recency_products_described": _on(lambda t: _described(t, False, False)),
    "low_recency_products_described_as_written": _on(lambda t: _described(t, False, True)),
    "high_recency_products_described_all": _on(lambda t: _described(t, True, False, None)),
    "low_recency_products_described_all": _on(lambda t: _described(t, False, False, None)),
    "high_recency_stock_top_n": _on(lambda t: A.stock_top_n(_recency_products(t, True, False), 5)),
    "high_recency_stock_lowest_n":
        _on(lambda t: A.stock_top_n(_recency_products(t, True, False), 5, ascending=True)),
    "churn_by_country": _on(lambda t: A.churn_by_country(t.features_in, t.rfm_churn())),
    "monetary_quantile": _on(lambda t: A.monetary_quantile(t.rfm_churn())),
    "monetary_quantile_audit": _on(lambda t: A.quantile_audit(t.rfm_churn())),
    "high_value_churned": _on(lambda t: A.high_value_churned(t.rfm_churn())),
    "high_value_churned_as_written": _on(lambda t: A.high_value_churned(t.final, customers=t.weighted())),
    "revenue_by_country": _on(lambda t: A.revenue_by_country(t.features_in)),
    "country_yoy": _on(lambda t: A.country_yoy(t.features_in)),
    "country_yoy_as_written": _on(lambda t: A.country_yoy(t.features_in, True, t.rfm_churn())),
    "top_countries": _on(lambda t: A.top_countries(t.features_in, 3)),
    "top_countries_ascending": _on(lambda t: A.top_countries(t.features_in, 5, ascending=True)),
    "monthly_revenue_top_countries": _on(lambda t: A.monthly_revenue_top_countries(t.features_in, 3)),
    "year_month_label": _on(lambda t: A.with_year_month(A.monthly_revenue_top_countries(t.features_in, 3))),
    "top_products_by_quantity": _on(lambda t: A.top_products_by_quantity(t.features_in, 10)),
    "top_products_by_quantity_ascending":
        _on(lambda t: A.top_products_by_quantity(t.features_in, 5, ascending=True)),
    "churned_top_products": _on(lambda t: A.churned_top_products(t.features_in, 3, t.rfm_churn())),
    "product_yoy": _on(lambda t: A.product_yoy(t.features_in)),
    "product_yoy_as_written": _on(lambda t: A.product_yoy(t.features_in, as_written=True)),
    "top_growth_products": _on(lambda t: A.top_growth_products(A.product_yoy(t.features_in), 20)),
    "top_growth_products_as_written":
        _on(lambda t: A.top_growth_products(A.product_yoy(t.features_in, as_written=True), 20)),
    "revenue_per_customer": _on(lambda t: A.revenue_per_customer(t.features_in, t.rfm_churn())),
    "revenue_per_customer_wide": _on(_per_customer_wide),
    "revenue_per_customer_long": _on(lambda t: A.revenue_per_customer_long(_per_customer_wide(t))),
    "top_customers": _on(lambda t: A.top_customers(t.rfm_churn(), "Monetary", 5)),
    "top_customers_lowest_recency":
        _on(lambda t: A.top_customers(t.rfm_churn(), "Recency", 5, ascending=True)),
}


def all_queries() -> dict[str, Query]:
    from tillroll.plans.segment_queries import SEGMENTS

    out: dict[str, Query] = {}
    for group in (SOURCES, PROFILE, CLEANING, FEATURES, ANALYSIS, SEGMENTS):
        out.update(group)
    return out
