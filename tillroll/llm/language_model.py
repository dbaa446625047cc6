"""Bigram language model by deleted interpolation.

The probability of a token after its context is a mixture of three maximum-
likelihood estimates: the bigram's, the token's, and a uniform one over the
training vocabulary and one unseen token. The mixture's weights depend on how
often the context occurs (powers of two). They are learnt by expectation-
maximisation on held-out counts: a tenth of the training documents is kept out
of the counts, and its tokens are the events. Final scores use the counts of all
training documents.

Counts are exact and cover every document: unigrams and bigrams of each chunk
are summed over all chunks (``chunks.tally``) and come back to the chunk, where
texts are scored. Tokens and bigrams are known by 64-bit hashes.

Edge cases. Null or empty text: the end token alone. No training documents: the
uniform estimate alone (one unseen token), score 0. Repeated rows count each.
Weights of a context bucket that no held-out token falls in are those of all
buckets together. A null id is in no test fold and so trains. Very long texts are
scored whole. An empty table has no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import chunks as ch
from tillroll.llm.common import cut, fold
from tillroll.llm.words import NOT_SPACE, TextBatch, U64, mix

START, END = U64(0x51A2B7C3D4E5F607), U64(0x0F1E2D3C4B5A6978)
RETAINED, DELETED, TEST = 0, 1, 2
_ODD = U64(1)
BUCKETS = 40
#: log10 estimates are counted on a grid for the weights; -99 stands for zero
_STEP, _ZERO = 20, -99 * 20
SCORES = "doc_id long, role int, n_tokens long, n_known long, base_score double, score double"


class Tokens:
    """Token, context and document of every token of a chunk, and its distinct keys."""

    def __init__(self, rows: pa.RecordBatch):
        batch = TextBatch(rows.column("text"), lower=True)
        starts, ends = batch.words(NOT_SPACE)
        words = batch.hashes(starts, ends) & ~_ODD
        counts = batch.counts_per_text(starts)
        self.n = counts + 1
        stop = np.cumsum(self.n)
        self.doc = np.repeat(np.arange(batch.n), self.n)
        token = np.empty(int(self.n.sum()), dtype=U64)
        token[np.arange(len(words)) + np.repeat(np.arange(batch.n), counts)] = words
        token[stop - 1] = END
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[stop - self.n] = START
        pair = mix(context * U64(3) ^ mix(token)) | _ODD
        self.keys, where = np.unique(np.concatenate([token, pair]), return_inverse=True)
        self.token, self.pair = where[:len(token)], where[len(token):]
        # a context is the token before; at a text's start it is no token
        self.context = np.append(0, self.token[:-1])
        self.opening = np.zeros(len(token), bool)
        self.opening[stop - self.n] = True


@dataclass
class Model:
    """Training totals and the mixture's weights: rows (bigram, unigram, uniform) by context bucket."""

    tokens: int
    vocabulary: int
    documents: int
    weights: np.ndarray


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of log2 of its count."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def estimates(t: Tokens, total: np.ndarray, documents: int, tokens: int):
    """Per token: its count, the context's bucket, and the two maximum-likelihood estimates."""
    c, both = total[t.token], total[t.pair]
    before = np.where(t.opening, documents, total[t.context])
    return c, context_bucket(before), both / np.maximum(before, 1), c / max(tokens, 1)


def learn_weights(events: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60, prior: float = 5.0) -> np.ndarray:
    """Expectation-maximisation on counted events (bucket, bigram estimate, unigram estimate, n)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    if not events:
        return weights
    bucket, p2, p1, n = (np.array(x) for x in zip(*events))
    p = np.stack([np.where(x == _ZERO, 0.0, 10.0 ** (x / _STEP)) for x in (p2, p1)] + [np.full(len(n), uniform)], axis=1)
    pooled = np.full(3, 1 / 3)
    for _ in range(rounds):
        part = p * pooled
        pooled = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0)
        pooled /= pooled.sum()
    weights[1:] = pooled
    for _ in range(rounds):
        part = p * weights[bucket]
        part = n[:, None] * part / part.sum(axis=1, keepdims=True)
        new = np.stack([np.bincount(bucket, weights=part[:, j], minlength=BUCKETS) for j in range(3)], axis=1) + prior * pooled
        new[0, 0] = 0.0
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _prepare(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Tokens]:
    t = Tokens(rows)
    role = np.asarray(rows.column("role"))[t.doc]
    at = np.concatenate([t.token, t.pair])
    role = np.concatenate([role, role])
    return t.keys, np.stack([np.bincount(at[role == r], minlength=len(t.keys)) for r in (RETAINED, DELETED)], axis=1), t


def _summary(keys: np.ndarray, sums: np.ndarray) -> bytes:
    """Tokens retained, tokens deleted, distinct training tokens, distinct retained tokens of a key range."""
    own = sums[(keys & _ODD) == 0]
    return np.array([own[:, 0].sum(), own[:, 1].sum(), (own.sum(axis=1) > 0).sum(), (own[:, 0] > 0).sum()], "<i8").tobytes()


def score_corpus(docs: DataFrame, folds: int = 5, test: int = 1, deleted: int = 10) -> tuple[DataFrame, Model]:
    """Scores of all documents (``SCORES``; role 2 is the test fold) and the model learnt from the others."""
    role = (F.when(F.coalesce(fold("doc_id", folds), F.lit(-1)) == test, TEST)
            .when(F.pmod(F.xxhash64("doc_id"), F.lit(deleted)) == 0, DELETED).otherwise(RETAINED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), role.alias("role"))
    # held-out documents have chunks of their own: the weights need only these
    n_bytes = ch.text_bytes(rows)
    held = ch.make_chunks(rows.filter(F.col("role") == DELETED), n_bytes)
    rest = ch.make_chunks(rows.filter(F.col("role") != DELETED), n_bytes).withColumn("chunk", F.col("chunk") + F.lit(1 << 62))
    chunks = held.unionByName(rest)
    totals = cut(ch.tally(chunks, _prepare, ch.bucket_count(n_bytes, 4 << 20), summary=_summary, strips=ch.strip_count(n_bytes)), ch.task_count(rows, n_bytes))
    parts = [np.frombuffer(r.totals, "<i8") for r in totals.filter("chunk = -1").select("totals").collect()]  # four numbers for each key range
    retained, dropped, vocabulary, seen = np.sum(parts, axis=0).tolist() if parts else (0, 0, 0, 0)
    n_docs = {r.role: r.n for r in rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    uniform = 1 / (seen + 1)

    def observe(block: ch.Block) -> pa.Table:
        _, bucket, p2, p1 = estimates(block.own, block.total[:, 0], n_docs.get(RETAINED, 0), retained)
        grid = [np.where(x > 0, np.round(np.log10(np.maximum(x, 1e-98)) * _STEP), _ZERO).astype(np.int64) for x in (p2, p1)]
        event, n = np.unique(np.stack([bucket, *grid], axis=1), axis=0, return_counts=True)
        return pa.table({"bucket": event[:, 0], "p2": event[:, 1], "p1": event[:, 2], "n": n})

    # at most as many rows as the grid has points, whatever the corpus
    events = (ch.with_totals(held, totals, _prepare, observe, "bucket long, p2 long, p1 long, n long", 2)
              .groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect())
    weights = learn_weights([tuple(r) for r in events], uniform)
    if not retained + dropped:
        weights[:] = (0.0, 0.0, 1.0)
    model = Model(retained + dropped, vocabulary, n_docs.get(RETAINED, 0) + n_docs.get(DELETED, 0), weights)
    smooth = math.log10(model.tokens + 0.5 * (model.vocabulary + 1))

    def apply(block: ch.Block) -> pa.Table:
        t, batch = block.own, block.rows
        c, bucket, p2, p1 = estimates(t, block.total.sum(axis=1), model.documents, model.tokens)
        w = model.weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (model.vocabulary + 1)
        size = batch.num_rows
        return pa.table({"doc_id": batch.column("doc_id"), "role": batch.column("role"), "n_tokens": t.n,
                         "n_known": np.bincount(t.doc[c > 0], minlength=size),
                         "base_score": np.bincount(t.doc, weights=np.log10(c + 0.5) - smooth, minlength=size),
                         "score": np.bincount(t.doc, weights=np.log10(np.maximum(p, 1e-300)), minlength=size)})

    return ch.with_totals(chunks, totals, _prepare, apply, SCORES, 2), model
