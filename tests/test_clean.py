from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.operators import profile as P
from tillroll.schemas import RAW


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, RAW)


def row(inv="1", code="10", desc="mug", qty=1, date="1/2/2011 8:26", price="2.55", cust="17850",
        country="UK"):
    return (inv, code, desc, qty, date, Decimal(price) if price is not None else None, cust, country)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_parse_date_bad_text_is_null_under_ansi_on_and_off(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = raw_rows(spark, [row(date="1/2/2011 8:26"), row(date="bad"), row(date=None)])
        got = [r.InvoiceDate for r in C.parse_invoice_date(df).collect()]
        assert str(got[0]) == "2011-01-02 08:26:00"
        assert got[1] is None and got[2] is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_fill_customer_text_id(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = raw_rows(spark, [row(cust="17850"), row(cust=None)])
        got = sorted(r.CustomerID for r in C.fill_customer(df).collect())
        assert got == ["17850", "Unknown"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_positive_drops_zeros_and_report_counts_them(spark):
    df = raw_rows(spark, [row(qty=0), row(price="0.00", inv="2"), row(qty=2, inv="3"), row(qty=-1, inv="4")])
    assert C.keep_positive(df).count() == 1
    rep = {r.step: r.rows for r in P.cleaning_report(df).collect()}
    assert rep["zero_quantity_after_dedup"] == 1
    assert rep["zero_price_after_dedup"] == 1
    assert rep["positive"] == 1


def test_exclude_codes_drops_listed_and_null(spark):
    df = raw_rows(spark, [row(code="POST"), row(code="gift_0001_10"), row(code=None), row(code="85123A")])
    assert [r.StockCode for r in C.exclude_codes(df).collect()] == ["85123A"]


def test_cancel_prefix_is_case_sensitive(spark):
    df = raw_rows(spark, [row(inv="C536379"), row(inv="c536379"), row(inv="536379")])
    assert P.profile_cancelled(df).first().cancelled_rows == 1


def test_cleaning_is_idempotent_and_duplicates_vanish(spark):
    rows = [row(inv=str(i), qty=i % 3, cust=None if i % 2 else "7") for i in range(12)]
    df = raw_rows(spark, rows)
    once = C.clean_transactions(df)
    doubled = C.clean_transactions(df.unionAll(df))
    assert sorted(once.collect()) == sorted(doubled.collect())
    # running the row filters again over cleaned rows changes nothing
    again = once.transform(C.drop_missing_description).transform(C.fill_customer) \
        .transform(C.deduplicate).transform(C.keep_positive).transform(C.exclude_codes)
    assert sorted(again.collect()) == sorted(once.collect())


def test_cleaning_report_matches_step_counts(spark):
    from tillroll.sources import testdata

    raw = testdata.raw_retail(spark, "/root/testdata/sf0.001")
    rep = {r.step: r.rows for r in P.cleaning_report(raw).collect()}
    expected = {s: C.clean_upto(raw, s).count()
                for s in ("drop_missing_description", "deduplicate", "positive", "exclude_codes")}
    assert rep["raw"] == raw.count() == 6068
    for s, n in expected.items():
        assert rep[s] == n
    assert expected["exclude_codes"] == 5743


def test_profile_duplicates_counts_extra_copies(spark):
    df = raw_rows(spark, [row(), row(), row(), row(inv="2")])
    assert P.profile_duplicates(df).first().duplicate_rows == 2


def test_profile_schema_counts_unparseable_dates(spark):
    df = raw_rows(spark, [row(date="bad"), row(date="1/2/2011 8:26"), row(date=None)])
    got = {r.column_name: r.unconvertible for r in P.profile_schema(df).collect()}
    assert got["InvoiceDate"] == 1 and got["Quantity"] == 0
