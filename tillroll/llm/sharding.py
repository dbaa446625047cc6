"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Each input partition sends a drawn number of rows to each bin, the counts of one
uniform permutation of all rows: row i of the communication matrix is a
multivariate hypergeometric draw given the rows before it. Rows are permuted
within their partition, exchanged, and permuted again within their bin. A bin is
a cell of a shard, at most ``cell_rows`` rows, so no task ever holds a shard.

The matrix is never held anywhere: partitions are the leaves of a binary tree,
each node splits its bins' counts between its halves with a generator seeded by
the node, and a task redraws only the nodes on its own path. The driver knows
one row count for each partition.

Law ``rows``: shard counts differ by at most one; where rows go depends on the
seed only. Edge cases: null or empty text has size 1 and crc32 0; repeated rows
are rows of their own; fewer rows than shards leaves shards empty; an empty
table gives no rows; very long texts travel whole. Other columns travel along;
``shuffle_into_shards`` raises where one has the name of a column that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut, task_partition

NUMPY_LIMIT = 10**9 - 1  # numpy's generator draws from smaller populations only


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n draws without replacement.

    Populations beyond numpy's limit: inverse of the distribution function over
    24 standard deviations around the mode, what lies outside is below 1e-30.
    """
    if good + bad <= NUMPY_LIMIT or min(good, bad, n, good + bad - n) == 0:
        return int(rng.hypergeometric(good, bad, n)) if good + bad <= NUMPY_LIMIT else (0 if good == 0 or n == 0 else n if bad == 0 else good)
    total = good + bad
    mode = int((n + 1) * (good + 1) // (total + 2))
    sd = max(1.0, (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5)
    lo, hi = max(0, n - bad, int(mode - 12 * sd) - 2), min(n, good, int(mode + 12 * sd) + 2)
    x = np.arange(lo, hi, dtype=np.float64)
    step = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)  # log p(x+1)/p(x)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    cdf = np.cumsum(p)
    return lo + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def split_counts(rng: np.random.Generator, bins: np.ndarray, n: int) -> np.ndarray:
    """n rows drawn without replacement from bins of given sizes: how many from each."""
    out = np.zeros_like(bins)
    rest = int(bins.sum())
    for i, size in enumerate(bins.tolist()):
        if not n:
            break
        rest -= size
        out[i] = got = hypergeometric(rng, size, rest, n)
        n -= got
    return out


def matrix_row(seed: int, row_counts: np.ndarray, bins: np.ndarray, i: int) -> np.ndarray:
    """Row i of the communication matrix: how many of partition i's rows go to each bin."""
    lo, hi, left = 0, len(row_counts), bins.copy()
    before = np.concatenate([[0], np.cumsum(row_counts)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = split_counts(np.random.default_rng([seed, lo, hi]), left, int(before[mid] - before[lo]))
        if i < mid:
            hi, left = mid, first
        else:
            lo, left = mid, left - first
    return left


def bin_sizes(total: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot in the shard) of each bin."""
    size, shard, first = [], [], []
    for s in range(shards):
        rows = total // shards + (s < total % shards)
        cells = max(1, -(-rows // cell_rows))
        at = 0
        for c in range(cells):
            n = rows // cells + (c < rows % cells)
            size.append(n)
            shard.append(s)
            first.append(at)
            at += n
    return np.array(size, np.int64), np.array(shard, np.int32), np.array(first, np.int64)


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 42, cell_rows: int = 100_000) -> DataFrame:
    """The rows with (shard, slot); slots are gapless from 0 in each shard.

    The rows are written to the checkpoint folder first, so that a repeated task
    sees the same rows in the same order.
    """
    clash = {"shard", "slot", "_bin", "_p", "_i"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    rows = cut(rows)
    counted = sorted((r.p, r.n) for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    at = {p: k for k, (p, _) in enumerate(counted)}
    row_counts = np.array([n for _, n in counted], np.int64)
    size, shard, first = bin_sizes(int(row_counts.sum()), shards, cell_rows)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = task_partition()
        if p not in at:
            return
        counts = matrix_row(seed, row_counts, size, at[p])
        label = np.repeat(np.arange(len(size), dtype=np.int32), counts)
        np.random.default_rng([seed, 1, at[p]]).shuffle(label)  # the local permutation
        i = 0
        for b in batches:
            n = b.num_rows
            extra = {"_bin": pa.array(label[i:i + n]), "_p": pa.array(np.full(n, at[p], np.int64)), "_i": pa.array(np.arange(i, i + n))}
            yield pa.RecordBatch.from_arrays([*b.columns, *extra.values()], names=[*b.schema.names, *extra])
            i += n

    def settle(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_p", "ascending"), ("_i", "ascending")])  # the order of arrival does not matter
        b = t.column("_bin")[0].as_py()
        slot = np.random.default_rng([seed, 2, b]).permutation(t.num_rows) + first[b]
        return (t.drop_columns(["_bin", "_p", "_i"]).append_column("shard", pa.array(np.full(t.num_rows, shard[b], np.int32)))
                .append_column("slot", pa.array(slot, pa.int64())))

    sent = rows.mapInArrow(send, f"{fields}, _bin int, _p long, _i long")
    return sent.groupBy("_bin").applyInArrow(settle, f"{fields}, shard int, slot long")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Documents' ids, sizes and checksums with their shard and slot, law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return (shuffle_into_shards(rows, shards, seed)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
