"""Joins of many rows with one row per key, when a few keys hold much of the rows.

AQE splits a skewed partition only where both sides of a join come straight from a
shuffle; a side that is an aggregate (one row per customer, per group) is not. Here
the rows of every key are dealt out over as many pieces as their measured number
asks for: a key that holds the share s of all rows gets ceil(s * ``pieces``) pieces,
and its single row is repeated for each of them.

Keys with more than one piece hold more than 1 / ``pieces`` of the rows each, so there
are fewer than ``pieces`` of them whatever the data: this table is broadcast. All other
keys need no lookup and keep one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key's rows are dealt out in pieces of about this share of all rows (and of at most one more row).
PIECES = 256
PIECE = "_piece"


def hot_keys(counts: DataFrame, keys: Sequence[str], n_col: str, pieces: int = PIECES) -> DataFrame:
    """(keys, _pieces) of the keys that need more than one piece; ``counts``: rows of each key. Fewer than ``pieces`` rows."""
    total = counts.agg(F.sum(n_col)).scalar()
    share = F.col(n_col).cast("decimal(38,0)") * pieces
    return counts.filter(share > total).select(*keys, F.ceil(share / total).cast("int").alias("_pieces"))


def deal_out(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with their piece: 0, or for hot keys a hash of the whole row."""
    spread = F.xxhash64(*[F.col(c) for c in rows.columns])
    piece = F.coalesce(F.pmod(spread, F.col("_pieces")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn(PIECE, piece).drop("_pieces")  # fewer than PIECES rows


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], counts: DataFrame, n_col: str,
                 how: str = "inner", pieces: int = PIECES) -> DataFrame:
    """``rows`` joined with one row per key; ``counts``: (keys, n_col), the number of rows of each key.

    Counts only steer the pieces: a key that they lack, or a number out of date,
    costs balance, never rows. Rows with a null key match nothing, as in any join.
    """
    hot = hot_keys(counts, keys, n_col, pieces)
    repeated = (per_key.join(F.broadcast(hot), list(keys), "left")  # fewer than PIECES rows
                .withColumn(PIECE, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))).drop("_pieces"))
    return deal_out(rows, hot, keys).join(repeated, [*keys, PIECE], how).drop(PIECE)
