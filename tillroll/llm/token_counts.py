"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

A byte-level tokenizer cuts a text into pre-tokens and encodes each on its own,
so a text's count is the sum of its pre-tokens' counts. Frequent pre-tokens are
found in tier one, a compact table that is broadcast; the others in tier two, a
cache of each Python worker that the tokenizer itself fills, one batch of misses
at a time. Texts are read once, in place: no pre-token and no text is shuffled.

Tier one is chosen from a random sample of about ``max_docs`` texts and holds at most
``max_entries`` pre-tokens of at most ``max_chars`` characters, so the broadcast has
the same bound at any input size (under 3 MB). It only saves time: counts are the
tokenizer's whatever the tables hold.

The worker cuts with the ``regex`` module, whose Unicode tables can be newer than
the tokenizer's. Each character that a worker meets for the first time is cut by
both; texts with a character on which they differ, and texts that hold one of the
tokenizer's added strings (which it reads as one token by default), go to the
tokenizer whole.

Edge cases. Null or empty text: 0 bytes, 0 tokens. Very long texts are cut where
white space follows something else, where a pre-token always ends, and counted
piece by piece. Repeated rows and null ids: one result row each. Empty table: no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import slices

#: Fixed value: how the byte-level tokenizer cuts texts (published with its vocabulary).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One string for each class a character can have: a letter, a digit, a mark, or white space.
PROBES = ("a{}a", "1{}1", "!{}!", " {}a")
PIECE_CHARS = 1 << 20


class PreTokens:
    """Cuts texts as the tokenizer does and knows the tokens of each piece."""

    def __init__(self, path: str, frequent: dict[str, int], max_cached: int = 400_000, max_chars: int = 64):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(PRE_TOKEN).findall
        self.end = regex.compile(r"(?<=\S)\s")
        self.alike, self.unlike = set(), set()  # characters cut alike by both, or not
        self.frequent, self.cached = frequent, {}
        self.max_cached, self.max_chars = max_cached, max_chars

    def _cut_alike(self, text: str) -> bool:
        """Whether both cut this text at the same places."""
        if any(a in text for a in self.added):
            return False
        new = set(text) - self.alike
        if not new:
            return True
        for c in new - self.unlike:
            probes = [p.format(c) for p in PROBES]
            same = all([p[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(p)] == self.find(p) for p in probes)
            (self.alike if same else self.unlike).add(c)
        return not new & self.unlike

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            m = self.end.search(text, at + PIECE_CHARS)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    def cut(self, text: str) -> Iterator[list[str]] | None:
        """Lists of pre-tokens, or None for a text that only the tokenizer cuts right."""
        return (self.find(p) for p in self._pieces(text)) if self._cut_alike(text) else None

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lengths(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (at least 1; 0 stands for unknown meanwhile)."""
        n = np.fromiter(map(self.frequent.get, tokens, repeat(0)), np.int64, len(tokens))
        missed = np.flatnonzero(n == 0)
        if len(missed):
            rest = [tokens[i] for i in missed.tolist()]
            new = sorted(set(rest).difference(self.cached))
            found = dict(zip(new, self._encoded(new))) if new else {}
            get = self.cached.get
            n[missed] = [get(t) or found[t] for t in rest]
            if len(self.cached) + len(found) > self.max_cached:
                self.cached = {}
            self.cached.update((t, k) for t, k in found.items() if len(t) <= self.max_chars)
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held, owner, size, whole = [], [], 0, []

        def settle() -> None:
            nonlocal held, owner, size
            if size:
                flat = held[0] if len(held) == 1 else [t for h in held for t in h]
                text = np.repeat(np.array(owner), [len(h) for h in held])
                out[:] += np.bincount(text, weights=self._lengths(flat), minlength=len(out)).astype(np.int64)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            pieces = self.cut(text)
            if pieces is None:
                whole.append(i)
                continue
            for tokens in pieces:
                held.append(tokens)
                owner.append(i)
                size += len(tokens)
                if size > 500_000:
                    settle()
        settle()
        for i in whole:
            out[i] = self._encoded([texts[i]])[0]
        return out


def frequent_lengths(docs: DataFrame, path: str, max_docs: int, max_entries: int, max_chars: int, text_col: str, seed: int = 3) -> pa.Table:
    """(piece, tokens) of the most frequent pre-tokens in about ``max_docs`` random texts; at most ``max_entries`` rows.

    One task counts the sample as a stream and forgets the rarest beyond 16 times ``max_entries``.
    """
    schema = pa.schema([("piece", pa.string()), ("tokens", pa.int32())])
    texts = docs.select(F.col(text_col).alias("text"))
    n = texts.count()
    if not n:
        return schema.empty_table()
    sample = texts.sample(min(1.0, max_docs / n), seed=seed).repartition(1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = PreTokens(path, {}), Counter()
        for b in slices(batches, "text", 1 << 20):
            for text in pc.fill_null(b.column("text"), "").to_pylist():
                for tokens in words.cut(text) or ():
                    seen.update(tokens)
                if len(seen) > 16 * max_entries:
                    seen = Counter(dict(seen.most_common(8 * max_entries)))
        top = [t for t, k in seen.most_common(max_entries) if len(t) <= max_chars]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(words._encoded(top) if top else [], pa.int32())], schema=schema)

    return sample.mapInArrow(count, "piece string, tokens int").toArrow()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, max_docs: int = 4_000, max_entries: int = 65_536, max_chars: int = 32,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text; ``limit``: the most tokens that are not over it."""
    top = frequent_lengths(docs, tokenizer_path, max_docs, max_entries, max_chars, text_col)
    table = docs.sparkSession.sparkContext.broadcast((top.column("piece").to_pylist(), np.array(top.column("tokens"), dtype=np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens = table.value
        words = PreTokens(tokenizer_path, dict(zip(pieces, tokens.tolist())))
        for b in slices(batches, "text", 1 << 20):
            text = pc.fill_null(b.column("text"), "")
            yield pa.RecordBatch.from_arrays([b.column("id"), pc.binary_length(text).cast(pa.int64()), pa.array(words.counts(text.to_pylist()), pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
