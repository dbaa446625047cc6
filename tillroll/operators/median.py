"""Exact median per group without gathering a group into one task.

Spark's exact ``percentile`` aggregate merges every distinct value of a group
into one buffer: a group holding a third of the data would sit in one task.
Here the exact answer is found in two passes over the rows:

1. per group, a mergeable quantile sketch (``percentile_approx``) gives a
   bracket [L, U] around the middle ranks; its rank error is at most n/accuracy,
   so the bracket is widened by a few times that and always contains them;
2. the brackets are joined to the rows; one combinable aggregate counts the
   values below L as a whole and the values inside the bracket as (value, count)
   pairs, and a running count over these locates the middle rank(s).

There is one bracket for each group. They are written and counted first: up to
``BROADCAST_GROUPS`` of them are broadcast, more are joined by a shuffle in which
values are counted before and the groups that hold much of them are dealt out
(``hot_keys``).

The pairs of a group meet in one task: up to about 8 · n/accuracy distinct values
of n, a share that ``accuracy`` sets.

The result equals Spark's ``percentile(x, 0.5)``: the middle value, or
0.5·lo + 0.5·hi for an even count, as double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.hot_keys import join_per_key
from tillroll.session import written

DEFAULT_ACCURACY = 10000
#: Most groups whose brackets (about 40 bytes each) are broadcast.
BROADCAST_GROUPS = 20_000


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str,
                 out_col: str = "median", accuracy: int = DEFAULT_ACCURACY,
                 broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per group with a value: ``group_cols`` + ``out_col`` (double). Groups with a null key are left out."""
    g = list(group_cols)
    vals = df.select(*g, F.col(value_col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    margin = 4.0 / accuracy
    bounds = written(vals.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", max(0.0, 0.5 - margin), accuracy).alias("_lo_b"),
        F.percentile_approx("_x", min(1.0, 0.5 + margin), accuracy).alias("_hi_b"),
    ))
    if bounds.count() <= broadcast_groups:
        tagged = vals.withColumn("_c", F.lit(1).cast("long")).join(F.broadcast(bounds), g)
    else:
        counted = vals.groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_c"))
        tagged = join_per_key(counted, bounds, g, bounds.select(*g, "_n"), "_n")
    # null stands for everything below the bracket and sorts first
    pairs = (tagged.filter(F.col("_x") <= F.col("_hi_b")).withColumn("_x", F.when(F.col("_x") >= F.col("_lo_b"), F.col("_x")))
             .groupBy(*g, "_n", "_x").agg(F.sum("_c").alias("_c")))
    w = Window.partitionBy(*g).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (pairs.withColumn("_end", F.sum("_c").over(w))
              .withColumn("_start", F.col("_end") - F.col("_c")))
    r_lo = F.floor((F.col("_n") - 1) / 2)
    r_hi = F.ceil((F.col("_n") - 1) / 2)
    hit_lo = (F.col("_start") <= r_lo) & (r_lo < F.col("_end"))
    hit_hi = (F.col("_start") <= r_hi) & (r_hi < F.col("_end"))
    picked = ranked.groupBy(*g).agg(
        F.max(F.when(hit_lo, F.col("_x"))).alias("_lo"),
        F.max(F.when(hit_hi, F.col("_x"))).alias("_hi"),
    )
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.lit(0.5) * F.col("_lo") + F.lit(0.5) * F.col("_hi"))
    return picked.select(*g, value.alias(out_col))
