"""Exact global counts for the keys of each chunk of rows.

A chunk is some MB of rows packed into one compressed record, written once to the
checkpoint folder. ``tally`` answers, for every key of every chunk, the sum of the
key's values over all chunks:

1. each chunk gives its distinct 64-bit keys with values, already summed over the
   chunk's rows (the map-side combine), cut into ranges of the key space;
2. each key range is summed in one group; a key that a third of all rows have
   comes there once for each chunk, so ranges stay even;
3. each chunk gets its own keys' totals back, in its own key order.

Keys travel as sorted deltas, numbers as compressed byte planes: a key costs
about six bytes on its way instead of a Spark row.

Sizes. The pieces that chunks and ranges exchange number chunks x ranges. Both are
made larger with the square root of the input (``chunk_size``, ``bucket_count``), so
their number grows in proportion to the input and a piece keeps holding hundreds of
keys. Inside, chunks and ranges are worked off in blocks and strips of fixed size,
so what a task holds beside the compressed pieces is a chunk's distinct keys:
about ten times the square root of the input's bytes times ``PIECE`` (100 MB at
100 GB, 3 GB at 100 TB).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut, task_partition
from tillroll.llm.words import give_back, slices

CHUNKS = "chunk long, n_rows long, n_bytes long, payload binary"
#: Least bytes of a chunk and of the blocks it is worked off in, and the bytes of a chunk that a piece stands for.
CHUNK, BLOCK, PIECE = 4 << 20, 1 << 19, 1 << 10


def pack(a: np.ndarray) -> bytes:
    """A 1-d number array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    b = bytes(b)
    dtype = np.dtype(b[:4].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as deltas."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def small_ints(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unpack_rows(b: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(bytes(b))).read_next_batch()


def chunk_size(n_bytes: int) -> int:
    """Bytes of a chunk for an input of so many bytes: constant first, then with its square root."""
    return max(CHUNK, math.isqrt(n_bytes * PIECE))


def task_count(rows: DataFrame, n_bytes: int) -> int:
    """Tasks that some bytes of input are worth, one for each core at least: the most files of what is written of them."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_bytes / (4 * CHUNK)))


def text_bytes(rows: DataFrame, size_col: str = "text") -> int:
    """Bytes of a column, summed in one pass."""
    return rows.agg(F.sum(F.octet_length(size_col)).alias("n")).first().n or 0


def make_chunks(rows: DataFrame, n_bytes: int, size_col: str = "text", chunk_bytes: int | None = None, write: bool = True) -> DataFrame:
    """All rows in chunks of about ``chunk_size(n_bytes)`` bytes of ``size_col``, written to the checkpoint folder.

    ``n_bytes``: bytes of that column in all (``text_bytes``).

    ``write=False`` only if the rows come straight from files written before, so
    that a repeated task packs the same rows into the same chunks.
    """

    chunk_bytes = chunk_bytes or chunk_size(n_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, i = task_partition(), 0
        for b in _regroup(batches, size_col, chunk_bytes):
            col = b.column(b.schema.get_field_index(size_col))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(p << 32) + i]), pa.array([b.num_rows]), pa.array([col.nbytes]), pa.array([pack_rows(b)], pa.binary())],
                names=["chunk", "n_rows", "n_bytes", "payload"])
            i += 1
        give_back()

    packed = rows.coalesce(max(task_count(rows, n_bytes), math.ceil(n_bytes / chunk_bytes))).mapInArrow(run, CHUNKS)
    return cut(packed) if write else packed


def _regroup(batches, size_col: str, chunk_bytes: int):
    """Join small batches up to the chunk size; large ones are cut."""
    held, size = [], 0
    for b in slices(batches, size_col, chunk_bytes, last=False):
        n = b.column(b.schema.get_field_index(size_col)).nbytes
        if held and size + n > chunk_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def blocks(rows: pa.RecordBatch, size_col: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A chunk's rows in blocks of about ``BLOCK`` bytes, with the index of each block's first row."""
    at = 0
    for b in _regroup([rows], size_col, BLOCK):
        yield at, b
        at += b.num_rows


def bucket_count(n_bytes: int, bytes_per_bucket: int) -> int:
    """Number of key ranges: one for so many bytes of the chunks, fewer where the chunks outgrow ``CHUNK``."""
    return max(1, math.ceil(n_bytes * CHUNK / bytes_per_bucket / chunk_size(n_bytes)))


def strip_count(n_bytes: int) -> int:
    """In how many parts a range is summed, one after the other."""
    return max(1, round(chunk_size(n_bytes) / CHUNK))


def edges_of(n: int) -> np.ndarray:
    """Lower bounds of n equal parts of the key space."""
    return np.array([(k << 64) // n for k in range(n)], dtype=np.uint64)


@dataclass
class Block:
    """A block of a chunk's rows and what is known of its keys.

    ``own``: what ``prepare`` made of the rows; ``total``: one row for each of its keys;
    ``fresh``: whether no earlier block of the chunk has the key; ``first_row``: index in the chunk.
    """

    chunk: int
    first_row: int
    rows: pa.RecordBatch
    own: object
    total: np.ndarray
    fresh: np.ndarray


Prepare = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, object]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several blocks and their summed values."""
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    values = np.concatenate([v for _, v in parts])
    return keys, np.stack([np.bincount(where, weights=values[:, j], minlength=len(keys)).astype(np.int64) for j in range(values.shape[1])], axis=1)


def tally(chunks: DataFrame, prepare: Prepare, n_buckets: int, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
          summary: Callable | None = None, size_col: str = "text", strips: int = 1) -> DataFrame:
    """Rows (chunk, bucket, totals): ``answer`` (by default the sum) for each key of the chunk in that range.

    ``prepare``: a block of rows -> ascending distinct keys, their non-negative integer
    values (one row of values for each key), and anything that ``with_totals`` needs.
    ``answer(sums, own, first)``: what a chunk gets back for its keys, given the global
    sums, its own values and whether it is the first chunk that has the key.
    ``summary(keys, sums)``: extra bytes for a strip of a range, in a row with chunk -1.
    ``strips``: in how many parts a range is summed (``strip_count``).
    """
    lower = edges_of(n_buckets * strips)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload")):
                parts = []
                for _, rows in blocks(unpack_rows(payload.as_buffer()), size_col):
                    keys, values, _ = prepare(rows)
                    parts.append((keys, values.reshape(len(keys), -1)))
                if not parts:
                    continue
                keys, values = _merged(parts)
                cuts = np.append(np.searchsorted(keys, lower), len(keys)).tolist()
                rows = []
                for k in range(n_buckets):
                    ends = cuts[k * strips:(k + 1) * strips + 1]
                    if ends[-1] > ends[0]:
                        own = list(zip(ends[:-1], ends[1:]))
                        rows.append((k, chunk, [pack_sorted(keys[a:z]) for a, z in own], [pack(small_ints(values[a:z, j])) for a, z in own for j in range(values.shape[1])]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.list_(pa.binary())), pa.array([r[3] for r in rows], pa.list_(pa.binary()))],
                                                 names=["bucket", "chunk", "keys", "vals"])
        give_back()

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        bucket, chunk = t.column("bucket")[0].as_py(), t.column("chunk").to_pylist()
        all_keys, all_vals = t.column("keys"), t.column("vals")
        width = len(all_vals[0]) // strips
        out, said = [[] for _ in chunk], []
        for strip in range(strips):
            keys = [unpack_sorted(k[strip].as_py()) for k in all_keys]
            packed = [[v[strip * width + j].as_py() for j in range(width)] for v in all_vals]
            size = [len(k) for k in keys]
            every, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            del keys
            is_first = np.zeros(len(where), bool)
            is_first[first] = True
            sums = np.stack([np.bincount(where, weights=np.concatenate([unpack(row[j]) for row in packed]), minlength=len(every)).astype(np.int64) for j in range(width)], axis=1)
            at = 0
            for n, row, blob in zip(size, packed, out):
                part = slice(at, at + n)
                got = sums[where[part]]
                if answer:
                    got = answer(got, np.stack([unpack(v).astype(np.int64) for v in row], axis=1), is_first[part])
                    got = got if got.ndim > 1 else got[:, None]
                blob += [len(x).to_bytes(4, "little") + x for x in (pack(small_ints(got[:, j])) for j in range(got.shape[1]))]
                at += n
            if summary:
                said.append(summary(every, sums))
        give_back()
        totals = [b"".join(blob) for blob in out]
        if summary:
            chunk, totals = [*chunk, *[-1] * len(said)], [*totals, *said]
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([bucket] * len(chunk), pa.int32()), "totals": pa.array(totals, pa.binary())})

    sent = chunks.mapInArrow(up, "bucket int, chunk long, keys array<binary>, vals array<binary>")
    return sent.groupBy("bucket").applyInArrow(combine, "chunk long, bucket int, totals binary")


def read_totals(parts: list[tuple[int, bytes]], columns: int = 1) -> np.ndarray:
    """A chunk's totals in its key order, (keys, columns), from its (bucket, totals) rows."""
    out = []
    for _, blob in sorted(parts, key=lambda x: x[0]):
        cols, at, blob = [], 0, bytes(blob)
        while at < len(blob):
            n = int.from_bytes(blob[at:at + 4], "little")
            cols.append(unpack(blob[at + 4:at + 4 + n]).astype(np.int64))
            at += 4 + n
        out += [np.stack(cols[i:i + columns], axis=1) for i in range(0, len(cols), columns)]
    return np.concatenate(out) if out else np.zeros((0, columns), np.int64)


def with_totals(chunks: DataFrame, totals: DataFrame, prepare: Prepare, run: Callable[[Block], pa.Table | None], schema: str, columns: int = 1, size_col: str = "text") -> DataFrame:
    """``run(block)`` for every block of every chunk; it returns a table in ``schema``.

    ``prepare`` as in ``tally``; ``columns``: how many numbers ``answer`` gave for each key.
    """
    back = totals.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals")).alias("parts"))
    joined = chunks.select("chunk", "payload").join(back, "chunk", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload, parts in zip(b.column("chunk").to_pylist(), b.column("payload"), b.column("parts")):
                total = read_totals([(x["bucket"], x["totals"]) for x in parts.as_py() or []], columns)
                held = []
                for at, rows in blocks(unpack_rows(payload.as_buffer()), size_col):
                    keys, _, own = prepare(rows)
                    held.append((at, rows, keys, own))
                every = held[0][2] if len(held) == 1 else np.unique(np.concatenate([h[2] for h in held])) if held else np.zeros(0, np.uint64)
                seen = np.zeros(len(every), bool)
                for i, (at, rows, keys, own) in enumerate(held):
                    held[i] = None
                    place = np.searchsorted(every, keys)
                    table = run(Block(chunk, at, rows, own, total[place], ~seen[place]))
                    seen[place] = True
                    if table is not None:
                        yield from table.combine_chunks().to_batches()
        give_back()

    return joined.mapInArrow(work, schema)
