"""Every oracle-checked registry query equals its DuckDB SQL on the sf0.001 tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as E  # noqa: E402
from tillroll.plans.catalog import all_queries  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in all_queries()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, df.collect()) == rows_of(dcols, res.fetchall())


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(all_queries()) - set(ORACLE)
    assert rows_only == {
        "monetary_quantile", "assemble_features", "kmeans_sweep", "silhouette", "pick_k",
        "kmeans_segments", "segment_sizes", "segment_stats", "segment_centers", "segment_cards",
        "segment_labels", "segment_totals", "segmented_customers",
        "kmeans_segments_as_written", "segment_totals_as_written"}


def test_entry_runs(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert [r.Churn for r in rows] == [0, 1]
    assert sum(r.Num_Customers for r in rows) == 151
