"""Connected components of a link table, without collecting it.

Links point from the larger to the smaller node. A task merges up to ``per_task``
links at once, as arrays; links that fit in one task are done with that, without a
shuffle. More links go on in rounds: each keeps every node's smallest target, hooks
its other targets onto that one, and lets every node jump to its target's target;
rounds end when no node has a second target and no target has one of its own.

Both sides of a round's joins are written before, so that AQE splits a node that a
third of all links lead to; smallest targets are combinable aggregates. What is
written is narrow (two ids a link), in as many files as ``per_task`` asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut


def union(node: pa.Array, root: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Every node of the links (distinct, ascending) and the smallest one of its group."""
    both = pa.chunked_array([*_chunks(node), *_chunks(root)]).combine_chunks().dictionary_encode()
    if isinstance(both, pa.ChunkedArray):
        both = both.combine_chunks()
    order = pc.array_sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    at = rank[np.asarray(both.indices)]
    label = smallest(at[:len(node)], at[len(node):], len(order))
    names = both.dictionary.take(order)
    return names, names.take(pa.array(label))


def _chunks(a) -> list[pa.Array]:
    return a.chunks if isinstance(a, pa.ChunkedArray) else [a]


def smallest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each group, for edges (u, v) between 0 .. n - 1."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(links: DataFrame, a: str = "a", b: str = "b", per_task: int = 500_000) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` should be read from files: it is counted first. The result is written.
    """
    kind = links.schema[a].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            node, root = union(*(pa.chunked_array([x.column(c) for x in held]) for c in ("node", "root")))
            yield pa.RecordBatch.from_arrays([node, root], names=["node", "root"])

    def merged(state: DataFrame) -> tuple[DataFrame, bool]:
        tasks = max(1, math.ceil(state.count() / per_task))
        return state.coalesce(tasks).mapInArrow(local, f"node {kind}, root {kind}"), tasks == 1

    state = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).filter("node <> root")
    while True:
        state, done = merged(state)
        if done:
            return cut(state)
        state = cut(state.filter("node <> root").distinct())
        least = cut(state.groupBy("node").agg(F.min("root").alias("low")))
        hooks = state.join(least, "node").filter("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"), F.lit(1).alias("changed"))
        jumps = (least.alias("x").join(least.alias("y"), F.col("x.low") == F.col("y.node"), "left")
                 .select("x.node", F.coalesce("y.low", "x.low").alias("root"), F.col("y.low").isNotNull().cast("int").alias("changed")))
        state = cut(jumps.unionByName(hooks))
        if not state.agg(F.max("changed").alias("c")).first().c:
            break
        state = state.select("node", "root")
    state = state.select("node", "root")
    return cut(state.unionByName(state.select(F.col("root").alias("node"), "root").distinct()))
