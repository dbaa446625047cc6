"""Exact quantiles of a number column, weighted or not, at any size.

The column's range is cut into ``BINS`` equal bins and the weights of each bin
are summed (a combinable aggregate); only the bin that holds the wanted rank is
cut again, until a bin is one value. Each pass, one job for all quantiles asked,
brings at most ``BINS`` rows for each of them to the driver; three or four passes
cover any money column. The answer does not depend
on the number of rows or partitions. The input is scanned once a pass, so give a
table or written rows, not a long plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
#: Widest range of values that is worked in 64-bit integers.
LONGS = 1 << 62


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float], weight: str | None = None, scale: int | None = None) -> list:
    """For each q the smallest value whose rows (or weights) reach the share q of all.

    ``scale``: decimals of the column's values; needed for doubles only, whose
    values must be rounded to it. Null values take no part; no rows give None.
    """
    kind = df.schema[column].dataType
    digits = scale if scale is not None else (kind.scale if isinstance(kind, T.DecimalType) else 0)
    # values as whole numbers of 10**-digits
    whole = F.round(F.col(column).cast(T.DecimalType(38, digits)) * F.lit(Decimal(10) ** digits), 0).cast(T.DecimalType(38, 0))
    rows = df.filter(F.col(column).isNotNull()).select(whole.alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n")).first()
    if not ends.n:
        return [None] * len(qs)
    rank = [max(1, math.ceil((q if isinstance(q, Fraction) else Fraction(str(q))) * ends.n)) for q in qs]
    # values count from the lowest one; as 64-bit integers where these suffice
    first, kind_of_v = int(ends.lo), "bigint" if int(ends.hi) - int(ends.lo) < LONGS else "decimal(38,0)"
    rows = rows.select((F.col("v") - F.lit(first).cast(T.DecimalType(38, 0))).cast(kind_of_v).alias("v"), "w")
    # of each q: the range its value lies in, and the weight below the range
    lo, hi, below = [0] * len(qs), [int(ends.hi) - first] * len(qs), [0] * len(qs)
    while open_ := [i for i in range(len(qs)) if lo[i] < hi[i]]:
        step = {i: -(-(hi[i] - lo[i] + 1) // BINS) for i in open_}
        ranges = {(lo[i], hi[i]): i for i in open_}  # quantiles in one range share its bins
        bins = [F.expr(f"CASE WHEN v BETWEEN {z} AND {y} THEN struct({i} AS i, CAST((v - CAST({z} AS {kind_of_v})) DIV CAST({step[i]} AS {kind_of_v}) AS BIGINT) AS b) END")
                for (z, y), i in ranges.items()]
        counts = (rows.select("w", F.explode(F.array_compact(F.array(*bins))).alias("x")).groupBy("x.i", "x.b")
                  .agg(F.sum("w").alias("w")).collect())
        for i in open_:
            for b, w in sorted((r.b, r.w) for r in counts if r.i == ranges[lo[i], hi[i]]):
                if below[i] + w >= rank[i]:
                    lo[i], hi[i] = lo[i] + b * step[i], min(hi[i], lo[i] + b * step[i] + step[i] - 1)
                    break
                below[i] += w
    out = []
    for v in lo:
        value = Decimal(v + first).scaleb(-digits)
        out.append(value if isinstance(kind, T.DecimalType) else float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else int(value))
    return out
