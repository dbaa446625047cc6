"""Concatenate-and-cut packing of token ids into fixed windows.

Pass 1 tokenises every whole text once and keeps the ids as compact binaries in
the checkpoint folder; each partition's token total is a row of a small table.
Prefix sums over those totals give each partition its global offset. Pass 2
walks each partition from its offset and emits one boundary record per piece, a
document's part of one window. Nothing is shuffled by key: only the totals (one
number for each partition) reach the driver.

Edge cases. Null or empty text: one piece that holds the end id alone. A text
longer than a window: pieces in consecutive windows. Repeated rows: each is
packed on its own. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut, task_partition
from tillroll.llm.words import LOWER, NOT_SPACE, TextBatch, ramp, slices

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


class WordIds:
    """Token ids of the white-space separated words, remembered between batches.

    The tokenizer never joins across ASCII white space, so a text's ids are its
    words' ids in order; each distinct word is encoded once per Python worker
    until ``max_words`` are known (then the memory starts anew: it only saves
    time, ids do not depend on it). Words are lower-cased before, as the tokenizer
    does after it has looked for its added tokens: words that hold one of these
    in any case are left as they are.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.max_words = max_words
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # of each key: index into first/length
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _batch(self, texts: pa.Array) -> TextBatch:
        """The texts in lower case, but words that hold an added token as they are."""
        batch = TextBatch(texts)
        raw, batch.buf = batch.buf, LOWER[batch.buf]
        data = batch.buf.tobytes()
        at = [m.start() for a in self.added if a in data for m in re.finditer(re.escape(a), data)]
        if at:
            starts, ends = batch.words(NOT_SPACE)
            for w in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                batch.buf[starts[w]:ends[w]] = raw[starts[w]:ends[w]]
        return batch

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per word."""
        ids, lengths = [], []
        for i in range(0, len(words), 2000):
            group = words[i:i + 2000]
            enc = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            size = np.fromiter(map(len, group), np.int64, len(group))
            start = np.cumsum(size + 1) - size - 1
            at = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc.ids))
            lengths.append(np.bincount(np.searchsorted(start, at, side="right") - 1, minlength=len(group)))
            ids.append(np.array(enc.ids, dtype=np.uint32))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, batch: TextBatch, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = batch.buf.tobytes()
        words = [data[a:z].decode("utf-8", "replace") for a, z in zip(starts.tolist(), ends.tolist())]
        flat, lengths = self._encode(words)
        first = len(self.flat) + np.cumsum(lengths) - lengths
        slots = len(self.first) + np.arange(len(keys))
        self.flat = np.concatenate([self.flat, flat])
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, lengths])
        all_keys, all_slots = np.concatenate([self.keys, keys]), np.concatenate([self.slot, slots])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.slot = all_keys[order], all_slots[order]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each text has."""
        batch = self._batch(texts)
        starts, ends = batch.words(NOT_SPACE)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(batch.n, np.int64)
        # a comma or full stop that follows a-z at a word's end is a word of its own: fewer distinct words
        last, before = batch.buf[ends - 1], batch.buf[np.maximum(ends - 2, 0)]
        tail = np.flatnonzero(((last == 44) | (last == 46)) & (ends - starts > 1) & (before >= 97) & (before <= 122))
        starts, ends = np.concatenate([starts, ends[tail] - 1]), np.concatenate([np.where(np.isin(np.arange(len(ends)), tail), ends - 1, ends), ends[tail]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        keys, one, where = np.unique(batch.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.max_words:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = one[~known]
            self._learn(batch, keys[~known], starts[new], ends[new])
            at = np.searchsorted(self.keys, keys)
        slot = self.slot[at][where]
        lengths = self.length[slot]
        flat = self.flat[np.repeat(self.first[slot], lengths) + ramp(lengths)]
        per_word_text = batch.text_of(starts)
        return flat, np.bincount(per_word_text, weights=lengths, minlength=batch.n).astype(np.int64)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids and the end id, little-endian unsigned 32-bit, zlib-packed as 16-bit where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(tokenizer_path)
        for b in slices(batches, text_col):
            flat, counts = model.ids(b.column(text_col))
            stop = np.cumsum(counts)
            narrow = not len(flat) or int(flat.max()) < 1 << 16 and end_id < 1 << 16
            flat = flat.astype("<u2" if narrow else "<u4")
            end = np.array([end_id], dtype=flat.dtype).tobytes()
            ids = [flat[z - c:z].tobytes() + end for c, z in zip(counts.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).cast(pa.int64()), pa.array(counts + 1, pa.int64()),
                 pa.array(np.full(b.num_rows, flat.dtype.itemsize, np.int32)), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "width", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


def partition_offsets(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each partition: prefix sums over one total for each partition."""
    totals = tokens.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n_tokens").alias("n")).collect()
    out, at = {}, 0
    for p, n in sorted((r.p, r.n) for r in totals):
        out[p] = at
        at += n
    return out


def cut_windows(tokens: DataFrame, window: int, emit: Callable | None = None, schema: str = PIECES) -> DataFrame:
    """One boundary record per piece of the written token table (see ``pack``)."""
    offsets = partition_offsets(tokens)
    total = sum(r.n for r in tokens.groupBy().agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = offsets.get(task_partition(), 0)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            pieces = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = np.repeat(first // window, pieces) + ramp(pieces)
            lo = np.maximum(seq * window, first[row])
            hi = np.minimum((seq + 1) * window, (first + n)[row])
            crc, ids, width = [], b.column("ids"), b.column("width").to_pylist()
            wide, last = None, -1
            for r, s, e in zip(row.tolist(), (lo - first[row]).tolist(), (hi - first[row]).tolist()):
                if r != last:
                    wide, last = np.frombuffer(ids[r].as_buffer(), dtype="<u2" if width[r] == 2 else "<u4").astype("<u4"), r
                crc.append(zlib.crc32(wide[s:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(lo - first[row]), pa.array(hi - lo), pa.array(crc, pa.int64()),
                 pa.array(n[row]), pa.array(seq), pa.array(lo - seq * window), pa.array(np.minimum(window, total - seq * window))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

    return tokens.mapInArrow(emit or run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens; only the last window can be short.

    ``sequence_length``: tokens of the piece's window before padding.
    """
    return cut_windows(cut(tokenise(docs, tokenizer_path, end_id)), window)
