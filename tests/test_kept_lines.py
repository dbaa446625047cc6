"""Reports of whole lines clean them once, in parts, and leave no shuffle files beside the lines they keep."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tillroll.operators import features
from tillroll.plans import prepared
from tillroll.plans.catalog import all_queries
from tillroll.plans.prepared import RetailTables

WHOLE_LINES = ["rfm_with_transactions", "transactions_with_rfm_churn", "transactions_with_churn"]


@pytest.fixture(scope="module")
def raw(spark):
    """Repeated lines, lines without invoice, and one invoice with a third of the lines."""
    rows = [("big" if i % 3 == 0 else None if i % 19 == 0 else f"{i % 60}", f"s{i % 7}", f"d{i % 7}" if i % 11 else None, i % 5 - 1, None if i % 13 == 0 else f"1/{1 + i % 28}/2011 8:00",
             None if i % 17 == 0 else 2.5, None if i % 4 == 0 else f"c{i % 9}", "X") for i in range(400)]
    return spark.createDataFrame(rows + rows[:90], "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID string, Country string"
                                 ).withColumn("UnitPrice", F.col("UnitPrice").cast("decimal(18,3)"))


def texts(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", WHOLE_LINES)
def test_whole_lines_do_not_join_the_tables_again(spark, name):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")
    assert plan.inputFiles() and not any("lineitem" in f for f in plan.inputFiles())


def test_parts_hold_every_line_once_and_copies_together(raw):
    parts = prepared.in_parts(raw, 3)
    rows = [texts(p) for p in parts]
    assert sorted(sum(rows, [])) == texts(raw) and sum(map(bool, rows)) > 1
    assert not any(set(a) & set(b) for i, a in enumerate(rows) for b in rows[i + 1:])


@pytest.mark.parametrize("lines", [0, 1, prepared.PART_LINES + 1, 100 * prepared.PART_LINES])
def test_kept_whole_lines_give_the_same_reports(raw, lines, monkeypatch):
    parts, cut = [], prepared.in_parts
    monkeypatch.setattr(prepared, "in_parts", lambda df, n: parts.append(n) or cut(df, n))
    t, kept = RetailTables(raw), RetailTables(raw, size=lambda: lines).kept()
    assert parts == [min(prepared.MAX_PARTS, max(1, -(-lines // prepared.PART_LINES)))]
    assert kept.cleaned.columns == t.cleaned.columns and texts(kept.cleaned) == texts(t.cleaned)
    assert texts(kept.customers) == texts(features.per_customer(t.features_in))
    for report in ("final_v1", "final", "final_v3"):
        got, want = getattr(kept, report), getattr(t, report)
        assert got.dtypes == want.dtypes and texts(got) == texts(want)


def test_no_shuffle_files_stay_beside_the_next_part(spark, raw, monkeypatch):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", blocks.getAllFiles().mkString(" ")))
    release, before, made = prepared.release_shuffles, shuffles(), []

    def released(session):
        made.append(shuffles() - before)
        release(session)
        until = time.time() + 30
        while shuffles() - before and time.time() < until:
            time.sleep(0.1)
        assert not shuffles() - before

    monkeypatch.setattr(prepared, "release_shuffles", released)
    RetailTables(raw, size=lambda: 100 * prepared.PART_LINES).kept()
    assert len(made) == prepared.MAX_PARTS + 1 and all(made)
