"""Removal of long repeated byte strings with a run-length index.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else, in the same or another document, is removed; matches never cross documents
and are judged on the input.

1. Every window of ``length`` bytes owns an anchor: the gram of ``gram`` bytes in
   it whose hash is smallest (the leftmost if equal). Equal windows own equal
   anchors, so only windows whose anchor occurs twice can repeat. Neighbouring
   windows with the same anchor form one context. Anchors and whole contexts are
   counted over all texts (``chunks.tally``).
2. Contexts with a repeated anchor become rows; of equal contexts only one, in
   the first chunk that has it, carries its bytes, so copies cost a row each and
   no text. A context that occurs twice repeats whole.
3. The distinct contexts are dealt out by anchor; the contexts of an anchor are
   indexed as a run-length index (``run_index``), whose matching statistics mark
   the windows that start in another context too.
4. Marked windows go back to all their occurrences and are cut out.

Hot anchors. The anchor of a very common passage may occur in a third of all
texts. Above ``hot`` occurrences its windows are regrouped in blocks of ``block``
starts by the whole string that all windows of a block share, so the different
surroundings of the passage fall apart into groups of their own.

Edge cases. Null text counts as empty: 0 bytes, nothing removed. Texts shorter
than ``length`` keep all bytes. Repeated rows and ids: each row is a document of
its own, and equal texts of at least ``length`` bytes are removed entirely. Very
long texts are worked off in blocks. An empty table gives no rows. Other columns are
ignored, or kept by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import chunks as ch
from tillroll.llm.common import cut
from tillroll.llm.run_index import RunIndex
from tillroll.llm.words import TextBatch, U64, _power_tables, give_back, mix, ramp

_BLOCK = 1 << 20
#: Bytes of contexts that are indexed together (an index takes about 100 times as much while it is made).
INDEX_BYTES = 600_000


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that start at each position (len - k + 1 of them)."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:len(buf)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the position of the smallest, the leftmost if equal."""
    n = len(h) - w + 1
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    pad = -len(key) % w
    grid = np.append(key, np.full(pad, ~U64(0))).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1:w - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)


class Contexts:
    """Maximal runs of windows with one anchor, over a batch of texts.

    ``first``/``count``: first window start (position in the batch) and number of
    windows; ``anchor``: position of the anchor; ``key``: its hash; ``text``: index.
    """

    def __init__(self, batch: TextBatch, length: int, gram: int):
        parts = []
        w = length - gram + 1
        step = max(_BLOCK, 4 * length)
        # windows in blocks of the batch, so that arrays stay small however long a text is
        for lo in range(0, max(len(batch.buf) - length + 1, 0), step):
            buf = batch.buf[lo:lo + step + length - 1]
            h = gram_hashes(buf, gram)
            owner = sliding_argmin(h, w)
            start = np.arange(lo, lo + len(owner))
            text = batch.text_of(start)
            inside = start + length <= batch.ends[text]
            start, text, owner = start[inside], text[inside], owner[inside]
            if not len(start):
                continue
            new = np.append(True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]))
            at = np.flatnonzero(new)
            parts.append((start[at], np.diff(np.append(at, len(start))), owner[at] + lo, h[owner[at]], text[at]))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64), np.zeros(0, np.int64)]
        self.first, self.count, self.anchor, self.key, self.text = cols


def _split_hot(batch: TextBatch, c: Contexts, rows: np.ndarray, length: int, gram: int, block: int):
    """Hot contexts in blocks of window starts at fixed distances from the anchor, keyed by what all windows of a block share."""
    distance = c.anchor[rows] - c.first[rows]  # of the first window; later windows are nearer
    low = distance - c.count[rows] + 1
    blocks = distance // block - low // block + 1
    row, j = np.repeat(rows, blocks), np.repeat(low // block, blocks) + ramp(blocks)
    far = np.minimum(np.repeat(distance, blocks), (j + 1) * block - 1)
    near = np.maximum(np.repeat(low, blocks), j * block)
    shared_from, shared_to = c.anchor[row] - j * block, c.anchor[row] - np.minimum((j + 1) * block - 1, length - gram) + length
    ends = batch.ends[c.text[row]]
    ok = (shared_to <= ends) & (shared_from >= batch.starts[c.text[row]])
    # a block whose shared string would leave the text has no equal elsewhere than at a text's edge: key it by its own windows' string
    a = np.where(ok, shared_from, c.anchor[row] - near)
    z = np.where(ok, shared_to, c.anchor[row] - far + length)
    key = mix(batch.hashes(a, z) ^ (j.astype(U64) << U64(1)) ^ ok.astype(U64))
    return row, c.anchor[row] - far, far - near + 1, key


def _context_keys(batch: TextBatch, c: Contexts, length: int) -> np.ndarray:
    """Hash of each context: its bytes, its anchor and the anchor's place."""
    return mix(batch.hashes(c.first, c.first + c.count + length - 1) ^ mix(c.key ^ (c.anchor - c.first).astype(U64)))


def repeated_ranges(chunks: DataFrame, n_bytes: int, length: int, gram: int, hot: int, block: int, group_bytes: int) -> DataFrame:
    """(chunk, row, start, spans): byte ranges of the chunked texts that repeat, as (offset, size) pairs from start; they may overlap."""
    odd = U64(1)

    def prepare(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple]:
        batch = TextBatch(rows.column("text"))
        c = Contexts(batch, length, gram)
        whole = _context_keys(batch, c, length) | odd
        # an anchor is the smallest hash of its window: mixed, it falls into any key range
        keys, one, where, n = np.unique(np.concatenate([mix(c.key) & ~odd, whole]), return_index=True, return_inverse=True, return_counts=True)
        return keys, n, (c, whole, one, where)

    # a key range sums about 800,000 keys: two for each context, which has about half as many windows as its anchor allows
    totals = ch.tally(chunks, prepare, ch.bucket_count(n_bytes, 200_000 * (length - gram + 1)), strips=ch.strip_count(n_bytes),
                      answer=lambda sums, own, first: np.concatenate([np.where(sums > 1, sums, 0), first[:, None]], axis=1))

    def candidates(block_: ch.Block) -> pa.Table:
        batch = TextBatch(block_.rows.column("text"))
        (c, whole, one, where), total = block_.own, block_.total
        n = len(whole)
        seen, copies = total[where[:n], 0], total[where[n:], 0]
        # of equal contexts, the first one in the first chunk that has it brings the bytes
        brings = (total[where[n:], 1] > 0) & block_.fresh[where[n:]] & (one[where[n:]] == np.arange(n, 2 * n))
        warm = np.flatnonzero((seen > 1) & (seen <= hot))
        row, first, count, key = _split_hot(batch, c, np.flatnonzero(seen > hot), length, gram, block)
        row, first, count, key = np.concatenate([warm, row]), np.concatenate([c.first[warm], first]), np.concatenate([c.count[warm], count]), np.concatenate([c.key[warm], key])
        digest = mix(batch.hashes(first, first + count + length - 1) ^ mix((c.anchor[row] - first).astype(U64)))
        data = batch.buf.tobytes()
        data = [data[a:a + k + length - 1] if b else None for a, k, b in zip(first.tolist(), count.tolist(), brings[row].tolist())]
        return pa.table({"grp": pa.array(key.view(np.int64)), "digest": pa.array(digest.view(np.int64)), "data": pa.array(data, pa.binary()),
                         "windows": pa.array(count), "copies": pa.array(copies[row]), "chunk": pa.array(np.full(len(row), block_.chunk)),
                         "row": pa.array(c.text[row] + block_.first_row), "start": pa.array(first - batch.starts[c.text[row]])})

    found = cut(ch.with_totals(chunks, totals, prepare, candidates, "grp long, digest long, data binary, windows long, copies long, chunk long, row long, start long", 2), ch.task_count(chunks, n_bytes))
    contexts = found.filter("data is not null").select("grp", "digest", "data")
    size = contexts.agg(F.sum(F.octet_length("data")).alias("n")).first().n or 0
    groups = max(1, math.ceil(size / group_bytes))

    def mark(t: pa.Table) -> pa.Table:
        t = t.sort_by("grp")
        data, group = t.column("data").to_pylist(), np.asarray(t.column("grp"))
        spans: list[list[int]] = [[] for _ in data]
        edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(data))
        # whole groups together, about INDEX_BYTES an index; a context alone in its group has no match elsewhere
        several = [(a, z) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()) if z - a > 1]
        held: list[int] = []
        size = 0
        for a, z in [*several, (None, None)]:
            if held and (a is None or size > INDEX_BYTES):
                _mark(held, data, spans, length)
                held, size = [], 0
            if a is not None:
                held += range(a, z)
                size += sum(len(data[i]) for i in range(a, z))
        give_back()
        keep = [i for i, s in enumerate(spans) if s]
        at = pa.array(keep, pa.int64())
        return pa.table({"grp": t.column("grp").take(at), "digest": t.column("digest").take(at), "spans": pa.array([spans[i] for i in keep], pa.list_(pa.int64()))})

    marked = (contexts.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(groups))).groupBy("part")
              .applyInArrow(lambda t: mark(t.drop_columns(["part"])), "grp long, digest long, spans array<long>"))
    marked = marked.groupBy("grp", "digest").agg(F.first("spans").alias("spans"))
    places = found.select("grp", "digest", "windows", "copies", "chunk", "row", "start")
    whole = places.filter("copies > 1").select("chunk", "row", "start", F.array(F.lit(0).cast("long"), F.col("windows") + (length - 1)).alias("spans"))
    return whole.unionByName(places.filter("copies <= 1").join(marked, ["grp", "digest"]).select("chunk", "row", "start", "spans"))


def _mark(which: list[int], data: list[bytes], spans: list[list[int]], length: int) -> None:
    """Add to spans the (offset, size) of the windows that another of these contexts has too."""
    index = RunIndex([data[i] for i in which])
    long_ = index.matching_statistics() >= length
    for i, a in zip(which, index.starts.tolist()):
        hit = np.append(long_[a:a + len(data[i]) - length + 1], False)
        if hit.any():
            step = np.diff(np.append(0, hit.astype(np.int8)))
            for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
                spans[i] += [x, y - x + length - 1]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of possibly overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def count_words(data: bytes) -> int:
    """Runs of bytes that are not ASCII white space."""
    return len(data.split())


def cut_repeats(docs: DataFrame, length: int = 400, gram: int = 64, hot: int = 4096, block: int = 48, group_bytes: int = 2 << 20,
                least_words: int = 0, long_bytes: int = 400) -> DataFrame:
    """Per document: doc (a struct of all its columns), n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and kept_text (their whole characters).

    ``least_words``: repeated runs of fewer words and of less than ``long_bytes`` bytes stay.
    """
    n_bytes = ch.text_bytes(docs)
    chunks = ch.make_chunks(docs, n_bytes)
    ranges = repeated_ranges(chunks.select("chunk", "payload"), n_bytes, length, gram, hot, block, group_bytes)
    back = ranges.groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "spans")).alias("found"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, found in zip(b.column("payload"), b.column("found")):
                rows = ch.unpack_rows(payload.as_buffer())
                spans: dict[int, list] = {}
                for x in found.as_py() or ():
                    s = x["spans"]
                    spans.setdefault(x["row"], []).extend((x["start"] + a, x["start"] + a + n) for a, n in zip(s[::2], s[1::2]))
                out = []
                for i, t in enumerate(rows.column("text")):
                    data = bytes(t.as_buffer()) if t.is_valid else b""
                    runs = [(a, z) for a, z in merged(spans.get(i, [])) if not least_words or z - a >= long_bytes or count_words(data[a:z]) >= least_words]
                    kept = b"".join(data[a:z] for a, z in zip([0, *(z for _, z in runs)], [*(a for a, _ in runs), len(data)]))
                    out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")))
                added = (pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())))
                doc = pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema))
                yield pa.RecordBatch.from_arrays([doc, *added], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])
        give_back()

    schema = T.StructType([T.StructField("doc", docs.schema), *(T.StructField(k, t) for k, t in (
        ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType()), ("kept_text", T.StringType())))])
    return (chunks.select("chunk", "payload").join(back, "chunk", "left").select("payload", "found")
            .mapInArrow(apply, schema))


def remove_repeats(docs: DataFrame, length: int = 400, least_words: int = 0, long_bytes: int = 400) -> DataFrame:
    """The documents, all columns, with their texts cut; ``n_chars``, if there, counts what is left.

    With ``least_words``, a repeated passage goes if it has that many words (and ``length`` bytes)
    or, with fewer or no words, ``long_bytes`` bytes: shorter repetitions are ordinary prose.
    A cut can fall inside a character; what is left of such a character goes too.
    A text that repeats whole becomes empty; its row stays.
    """
    cut_docs = cut_repeats(docs, length, least_words=least_words, long_bytes=long_bytes)
    kept = F.when(F.col("n_removed") == 0, F.col("doc.text")).otherwise(F.col("kept_text"))
    out = {"text": kept} | ({"n_chars": F.when(F.col("n_removed") == 0, F.col("doc.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut_docs.select(*[out[c].alias(c) if c in out else F.col("doc").getField(c).alias(c) for c in docs.columns])


def dedup_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, and the SHA-256 of what is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return cut_repeats(rows, length).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
