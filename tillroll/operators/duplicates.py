"""Repeated rows by a narrow key instead of whole rows.

A row's key is two 64-bit hashes of all its columns (and of which are null), with
different seeds. Counting equal keys shuffles 24 bytes for each distinct row and
map task, whatever the row's width; rows that repeat often collapse before the shuffle.

- ``duplicate_rows`` and ``key_counts`` count on keys alone. Two different rows
  of 10**12 share a key with a chance of about 10**-15.
- ``deduplicate`` is exact: whole rows are compared and shuffled wherever a key
  occurs twice; all other rows pass through in place.

The repeated keys are broadcast if there are at most ``MAX_KEYS`` of them (they are
written and counted first); beyond that, whole rows are grouped (``distinct_rows``). Null equals null, and -0.0 equals 0.0, as in any grouping.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import written

KEYS = ("_key1", "_key2")
#: Most repeated keys that are broadcast: 16 bytes each, about 64 MB as a hash table.
MAX_KEYS = 1_000_000


def with_key(df: DataFrame) -> DataFrame:
    """The rows with their key. Hashes skip nulls, so the places of nulls are hashed too."""
    nulls = [F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in df.columns])] if df.columns else []
    values = [F.when(F.col(f.name) == 0, F.lit(0.0)).otherwise(F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    return df.select("*", *[F.xxhash64(F.lit(seed), *nulls, *values).alias(k) for seed, k in enumerate(KEYS, 1)])


def key_counts(df: DataFrame, flags: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, flags, _n): how many rows have each key; ``flags``: small functions of the row that come along."""
    keyed = with_key(df).select(*KEYS, *[c.alias(n) for n, c in (flags or {}).items()])
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row."""
    return key_counts(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def repeated_keys(df: DataFrame) -> DataFrame:
    """The keys of rows that occur more than once."""
    return key_counts(df).filter(F.col("_n") > 1).select(*KEYS)


def deduplicate(df: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """Rows without repeats; only rows whose key occurs twice are shuffled whole. Reads the rows three times."""
    again = written(repeated_keys(df))
    n = again.count()
    if not n:
        return df
    if n > max_keys:
        return distinct_rows(df)
    marked = with_key(df).join(F.broadcast(again.withColumn("_again", F.lit(True))), list(KEYS), "left")  # at most max_keys rows
    once = marked.filter(F.col("_again").isNull()).select(*df.columns)
    return once.unionByName(marked.filter(F.col("_again")).select(*df.columns).dropDuplicates())


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows without repeats, whole rows compared, in tasks of even size.

    A hash table of whole rows takes many times the bytes that a join's input shuffles, so
    rows are not grouped in the tasks that made them but after one shuffle of whole rows,
    in partitions that AQE sizes by these rows. The copies of a row meet in one task, which
    holds one of them: a row repeated very often costs that task time, not memory.
    """
    return df.hint("rebalance", *[F.col(c) for c in df.columns]).dropDuplicates()
