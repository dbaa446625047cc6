"""Benchmark decontamination by a prefix-filtered join of shingles.

An item is a sequence of lower-cased words; its windows are its runs of
``window`` words (a shorter item is one window). A window occurs in a document
where all its words occur in order, so all its shingles must be there: the
containment threshold is 1 and the necessary prefix of a window is a single
shingle, its rarest. Pass 1 counts every benchmark shingle over all documents.
Pass 2 joins document shingles with the windows' rarest shingles, bounds the
window's place by the shingle's position and the document's length, and
verifies the window word by word.

A benchmark of at most ``block_bytes`` of text (it is measured first) is indexed as
a whole and sent to the tasks; documents are then read twice and nothing of them is
shuffled. A larger one stays in Spark rows: windows are made in tasks, their shingles
counted and the rarest chosen by aggregates, and candidates joined and verified as
rows. Two bit tables of at most ``FILTER_BITS`` bits keep the shingles of documents
that no window has from being shuffled; they only save work. Documents are read
three times then, however large the benchmark is, and it never reaches the driver.

Edge cases. Null or empty text: no words, nothing hit. An item without words is
never found. Rows that repeat an item_id are one item with the windows of all; so
are the rows with a null item_id, which count in n_hit and n_items but have no
name in items_sha256 (as in the SQL).
Repeated documents: each row has its result. Empty tables: no rows, or no hits.
Very long texts are read whole. Other columns are ignored, or kept by
``drop_contaminated``, whatever their names. A text is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut
from tillroll.llm.words import ALNUM, TextBatch, ngrams, ngrams_by_text, ramp, slices

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Most bits of a table of shingles (128 MB); fewer for fewer shingles.
FILTER_BITS = 1 << 30
_WINDOWS = "item string, words array<long>, grams array<long>"
_FOUND = "doc_id long, digest string, n_words long, gram long, at long, around array<long>"


class WindowIndex:
    """The distinct windows of some items, found by one prefix shingle each.

    ``words``: (windows, window) word hashes, zero beyond a window's length;
    ``owner``/``items``: which items have which window.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int):
        batch = TextBatch([t for _, t in items], lower=True)
        starts, ends = batch.words(ALNUM)
        hashes, counts = batch.hashes(starts, ends), batch.counts_per_text(starts)
        at = np.cumsum(counts) - counts
        seen: dict[bytes, int] = {}
        rows, length, pairs = [], [], set()
        for (item, _), a, n in zip(items, at.tolist(), counts.tolist()):
            for s in range(a, a + max(n - window, 0) + 1 if n else a):
                row = np.zeros(window, np.uint64)
                row[:min(n, window)] = hashes[s:s + min(n, window)]
                k = seen.setdefault(row.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(row)
                    length.append(min(n, window))
                pairs.add((k, item))
        self.words = np.array(rows, dtype=np.uint64).reshape(-1, window)
        self.length = np.array(length, dtype=np.int64)
        self.owners: list[list[str]] = [[] for _ in rows]
        for k, item in sorted(pairs, key=lambda p: (p[0], p[1] or "")):
            self.owners[k].append(item)
        self.shingle = shingle
        # shingles of each window; a window shorter than a shingle is one shorter shingle
        self.grams: list[np.ndarray] = [ngrams(r[:n], min(shingle, int(n))) for r, n in zip(self.words, self.length)]
        self.all_grams = {n: np.unique(np.concatenate([g for g, m in zip(self.grams, self.length) if min(shingle, m) == n] or [np.zeros(0, np.uint64)]))
                          for n in range(1, shingle + 1)}

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        """Choose each window's prefix: its rarest shingle; drop windows with a shingle that no document has."""
        keep, token, offset = [], [], []
        for k, g in enumerate(self.grams):
            n = [counts.get(int(x), 0) for x in g]
            j = min(range(len(n)), key=lambda i: (n[i], int(g[i])))
            if n[j]:
                keep.append(k)
                token.append(g[j])
                offset.append(j)
        self.prefix = {}
        sizes = np.minimum(self.length[keep], self.shingle) if keep else np.zeros(0, np.int64)
        for size in range(1, self.shingle + 1):
            own = np.flatnonzero(sizes == size)
            t = np.array([token[i] for i in own], dtype=np.uint64)
            order = np.argsort(t, kind="stable")
            self.prefix[size] = (t[order], np.array([keep[own[i]] for i in order], dtype=np.int64), np.array([offset[own[i]] for i in order], dtype=np.int64))
        self.grams = []

    def find(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified occurrences in a batch: (text, first word in the batch, window)."""
        ends = np.cumsum(counts)
        starts = ends - counts
        out = []
        for size, (tokens, window, offset) in self.prefix.items():
            if not len(tokens):
                continue
            grams, text, first = ngrams_by_text(hashes, counts, size)
            lo, hi = np.searchsorted(tokens, grams, "left"), np.searchsorted(tokens, grams, "right")
            hit = np.flatnonzero(hi > lo)
            per = (hi - lo)[hit]
            entry = np.repeat(lo[hit], per) + ramp(per)
            text, at, w = np.repeat(text[hit], per), np.repeat(first[hit], per) - offset[entry], window[entry]
            fits = (at >= starts[text]) & (at + self.length[w] <= ends[text])  # positional and length bounds
            text, at, w = text[fits], at[fits], w[fits]
            same = np.ones(len(w), bool)
            for j in range(self.words.shape[1]):
                same &= (j >= self.length[w]) | (hashes[np.minimum(at + j, len(hashes) - 1)] == self.words[w, j])
            out.append((text[same], at[same], w[same]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


def _hits(index: WindowIndex, b: pa.RecordBatch, text_col: str):
    """Per text of the batch: number of words, covered word ranges, items."""
    batch = TextBatch(b.column(text_col), lower=True)
    starts, ends = batch.words(ALNUM)
    hashes, counts = batch.hashes(starts, ends), batch.counts_per_text(starts)
    text, at, w = index.find(hashes, counts)
    first = np.cumsum(counts) - counts
    spans: dict[int, set] = {}
    items: dict[int, set] = {}
    for t, a, k in set(zip(text.tolist(), at.tolist(), w.tolist())):
        spans.setdefault(t, set()).add((a - int(first[t]), a - int(first[t]) + int(index.length[k])))
        items.setdefault(t, set()).update(index.owners[k])
    return counts, spans, items


def covered(spans) -> int:
    """Words inside any of the ranges."""
    n, reach = 0, 0
    for a, z in sorted(spans):
        n += max(0, z - max(a, reach))
        reach = max(reach, z)
    return n


def _row(n_words: int, spans, items) -> tuple:
    hit = covered(spans)
    return hit, len(items), hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words


def shingle_counts(docs: DataFrame, index: WindowIndex, text_col: str) -> dict[int, int]:
    """How often each benchmark shingle occurs in all documents (as many numbers as the block has shingles)."""
    wanted = index.all_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(t), np.int64) for n, t in wanted.items()}
        for b in slices(batches, text_col):
            batch = TextBatch(b.column(text_col), lower=True)
            starts, ends = batch.words(ALNUM)
            hashes, counts = batch.hashes(starts, ends), batch.counts_per_text(starts)
            for n, t in wanted.items():
                if len(t):
                    g, _, _ = ngrams_by_text(hashes, counts, n)
                    at = np.minimum(np.searchsorted(t, g), len(t) - 1)
                    totals[n] += np.bincount(at[t[at] == g], minlength=len(t))
        g = np.concatenate([t[totals[n] > 0] for n, t in wanted.items()])
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.concatenate([c[c > 0] for c in totals.values()]))], names=["gram", "n"])

    rows = docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram % (1 << 64): r.n for r in rows}


def text_size(items: DataFrame, text_col: str) -> int:
    """Bytes of all item texts."""
    return items.agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit("")))).alias("n")).first().n or 0


def small_index(docs: DataFrame, items: DataFrame, window: int, shingle: int, item_col: str, item_text_col: str):
    """Broadcast index of a benchmark whose size was measured before."""
    index = WindowIndex([(r.id, r.t) for r in items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("t")).collect()], window, shingle)
    index.order_by_rarity(shingle_counts(docs.select("text"), index, "text"))
    return docs.sparkSession.sparkContext.broadcast(index)


# --- a benchmark of any size, as rows ----------------------------------------------


def window_rows(items: DataFrame, window: int, shingle: int, item_col: str, item_text_col: str) -> DataFrame:
    """(item, words, grams) of every window of every item; item is its id after an n, or empty without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            batch = TextBatch(b.column("t"), lower=True)
            starts, ends = batch.words(ALNUM)
            hashes, counts = batch.hashes(starts, ends), batch.counts_per_text(starts)
            first = np.cumsum(counts) - counts
            for item, a, n in zip(b.column("id").to_pylist(), first.tolist(), counts.tolist()):
                length = min(n, window)
                if not n:
                    continue
                size = min(shingle, length)
                own, grams = hashes[a:a + n], ngrams(hashes[a:a + n], size)
                words = np.lib.stride_tricks.sliding_window_view(own, length)
                gram = np.lib.stride_tricks.sliding_window_view(grams, length - size + 1)
                for lo in range(0, len(words), 20_000):
                    w, g = (np.ascontiguousarray(x[lo:lo + 20_000]).view(np.int64) for x in (words, gram))
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (w, g)]
                    yield pa.RecordBatch.from_arrays([pa.array(["" if item is None else "n" + item] * len(w), pa.string()), *lists], names=["item", "words", "grams"])

    own = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("t"))
    return own.mapInArrow(run, _WINDOWS)


class Filter:
    """A bit table of 64-bit hashes: says no only for hashes that are not in it."""

    def __init__(self, hashes: DataFrame, column: str, most_bits: int = FILTER_BITS):
        bits = min(most_bits, 1 << max(16, (8 * hashes.count()).bit_length()))
        at = F.col(column).bitwiseAND(F.lit(bits - 1))
        rows = (hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b"))
                .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())  # at most bits / 64 rows
        self.mask, self.table = np.uint64(bits - 1), np.zeros(bits // 64, np.uint64)
        self.table[np.asarray(rows.column("w"))] = np.asarray(rows.column("b")).view(np.uint64)

    def may_have(self, g: np.ndarray) -> np.ndarray:
        return (self.table[((g & self.mask) >> np.uint64(6)).astype(np.int64)] >> (g & np.uint64(63))) & np.uint64(1) > 0


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, offset, words, items): every different window whose shingles all occur in documents, under its rarest one."""
    grams = cut(windows.select(F.explode("grams").alias("gram")).distinct())
    sent = docs.sparkSession.sparkContext.broadcast(Filter(grams, "gram"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            batch = TextBatch(b.column("text"), lower=True)
            starts, ends = batch.words(ALNUM)
            hashes, counts = batch.hashes(starts, ends), batch.counts_per_text(starts)
            for n in sizes:
                g, _, _ = ngrams_by_text(hashes, counts, n)
                g, k = np.unique(g[sent.value.may_have(g)], return_counts=True)  # summed before they travel
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(k)], names=["gram", "n"])

    seen = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    known = cut(seen.join(grams, "gram", "left_semi"))
    whole = cut(windows.groupBy("words", "grams").agg(F.collect_set("item").alias("items")))
    places = whole.select("words", F.posexplode("grams").alias("offset", "gram"))
    rarest = (places.join(known, "gram").groupBy("words").agg(F.min(F.struct("n", "gram", "offset")).alias("p"), F.count(F.lit(1)).alias("found")))
    return cut(whole.join(rarest, "words").filter(F.col("found") == F.size("grams")).select("p.gram", "p.offset", "words", "items"))


def found_windows(docs: DataFrame, prefix: DataFrame, sizes: list[int], window: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, digest, n_words), and the verified ranges in them: (doc_id, digest, a, z, items)."""
    sent = docs.sparkSession.sparkContext.broadcast(Filter(prefix.select("gram").distinct(), "gram"))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()), ("gram", pa.int64()), ("at", pa.int64()), ("around", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            batch = TextBatch(b.column("text"), lower=True)
            starts, ends = batch.words(ALNUM)
            hashes, counts = batch.hashes(starts, ends), batch.counts_per_text(starts)
            begin = np.cumsum(counts) - counts
            padded = np.concatenate([np.zeros(window - 1, np.uint64), hashes, np.zeros(window, np.uint64)]).view(np.int64)
            around = np.lib.stride_tricks.sliding_window_view(padded, 2 * window - 1)
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(counts, pa.int64()), *(none.cast(t) for t in schema.types[3:])], schema=schema)
            for n in sizes:
                g, text, first = ngrams_by_text(hashes, counts, n)
                hit = np.flatnonzero(sent.value.may_have(g))
                for lo in range(0, len(hit), 10_000):
                    i = hit[lo:lo + 10_000]
                    t, words = pa.array(text[i]), np.ascontiguousarray(around[first[i]])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(t), b.column("digest").take(t), pa.array(counts[text[i]], pa.int64()), pa.array(g[i].view(np.int64)),
                                                      pa.array(first[i] - begin[text[i]], pa.int64()), lists], schema=schema)

    rows = cut(docs.mapInArrow(run, _FOUND))
    place, length = F.col("at") - F.col("offset"), F.size("words")
    hits = (rows.filter("gram is not null").join(prefix, "gram")
            .filter((place >= 0) & (place + length <= F.col("n_words")))  # positional and length bounds
            .filter(F.slice("around", F.lit(window) - F.col("offset"), length) == F.col("words")))
    return rows.filter("gram is null").select("doc_id", "digest", "n_words"), hits.select("doc_id", "digest", place.alias("a"), (place + length).alias("z"), "items")


def by_rows(docs: DataFrame, items: DataFrame, window: int, shingle: int, item_col: str, item_text_col: str) -> DataFrame:
    """Results with digest for a benchmark of any size; ``docs``: (doc_id, text)."""
    own = docs.withColumn("digest", F.sha2("text", 256))
    windows = cut(window_rows(items, window, shingle, item_col, item_text_col).distinct())
    sizes = sorted(r.n for r in windows.select(F.least(F.size("words"), F.lit(shingle)).alias("n")).distinct().collect())  # at most ``shingle`` numbers
    every, hits = found_windows(own, prefixes(own, windows, sizes), sizes, window)
    hits = cut(hits.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("a", "z")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                            ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        for b in batches:
            rows = []
            for doc, digest, n, spans, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "n_words", "spans", "items"))):
                names = {i[1:] if i else None for i in found or ()}
                rows.append((doc, digest, n, *_row(n, {(s["a"], s["z"]) for s in spans or ()}, names)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    same = F.col("e.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("e.digest").eqNullSafe(F.col("h.digest"))
    return (every.alias("e").join(hits.alias("h"), same, "left").select("e.doc_id", "e.digest", "n_words", "spans", "items")
            .mapInArrow(merge, RESULT.replace("n_words", "digest string, n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 3, block_bytes: int = 8 << 20,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: hit words, items found and the contamination decision."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if text_size(items, item_text_col) > block_bytes:
        return by_rows(own, items, window, shingle, item_col, item_text_col).drop("digest")
    sent = small_index(own, items, window, shingle, item_col, item_text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, spans, found = _hits(sent.value, b, "text")
            rows = [_row(n, spans.get(i, ()), found.get(i, ())) for i, n in enumerate(counts.tolist())]
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))],
                                             names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return own.mapInArrow(whole, RESULT)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 3, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    if text_size(items, "text") > block_bytes:  # what a text holds decides, so texts are told apart by their digest
        bad = by_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, shingle, "item_id", "text").filter("contaminated").select("digest").distinct()
        return docs.alias("d").join(bad.alias("bad"), F.sha2(F.col("d.text"), 256) == F.col("bad.digest"), "left_anti")
    sent = small_index(docs, items, window, shingle, "item_id", "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, spans, _ = _hits(sent.value, b, "text")
            hit = np.array([covered(spans.get(i, ())) for i in range(b.num_rows)], np.int64)
            yield b.filter(pa.array((hit == 0) | (20 * hit < counts)))

    return docs.mapInArrow(keep, docs.schema)
