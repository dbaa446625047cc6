"""Language identification: known words first, character n-grams for the rest.

Each known word adds its log frequency in each language. A word that training
never saw backs off: its longest character n-grams (with word boundaries) that
training did see add the mean of their log frequencies; only if none of length n
is known are those of length n-1 tried, down to single characters. The sums give
a posterior over the languages.

Bounds: training reads at most about ``max_docs`` texts for each language and
``max_total`` in all, chosen by a hash of id and text, and keeps every word and
n-gram of them in every language. What is sent to the tasks is one number for each
(word or n-gram, language) that occurs in these. More than 10,000 languages are an
error. Prediction reads whole texts.

Edge cases. Text null or without a letter: ``und`` with score 0. No training
rows: every other text is ``und`` too, score 0. A text whose words and n-grams
are all unknown: the most frequent training language (first by name if equal).
Repeated rows: each has its prediction; in training they count once. Very long
texts are read whole. An empty table has no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import draw, fold, share_of_draws
from tillroll.llm.words import TextBatch, byte_class, ramp, slices

#: byte class of words: a-z and all non-ASCII bytes, after lower-casing
_LETTERS = byte_class([b for b in range(128) if not 97 <= b <= 122])


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def _marked(words: list[bytes]) -> TextBatch:
    """A batch with one word per text, between boundary marks."""
    return TextBatch(pa.array([b"\x02" + w + b"\x03" for w in words], pa.binary()).cast(pa.string()))


def _grams(batch: TextBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-character grams of each text, and their text."""
    char = np.flatnonzero((batch.buf & 0xC0) != 0x80)  # first byte of each character, line feeds included
    text = batch.text_of(char)
    inside = char < batch.ends[text]
    char, text = char[inside], text[inside]
    m = len(char) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = np.append(char[1:], batch.ends[-1])
    last_of_text = np.append(text[1:] != text[:-1], True)
    stop[last_of_text] = batch.ends[text[last_of_text]]
    same = text[:m] == text[n - 1:]
    return batch.hashes(char[:m][same], stop[n - 1:][same]) ^ np.uint64(n), text[:m][same]


@dataclass
class LogTable:
    """Log frequencies of keys in languages: ``logs[first[i]:first[i + 1]]`` are key i's, in the languages ``lang`` there.

    In all other languages a key has their ``absent``.
    """

    keys: np.ndarray  # sorted
    first: np.ndarray
    lang: np.ndarray
    logs: np.ndarray
    absent: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each key, and whether the table has it."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Log frequencies of the keys of these indices, one column per language."""
        out = np.tile(self.absent, (len(at), 1))
        n = self.first[at + 1] - self.first[at]
        pair = np.repeat(self.first[at], n) + ramp(n)
        out[np.repeat(np.arange(len(at)), n), self.lang[pair]] = self.logs[pair]
        return out


@dataclass
class LanguageModel:
    """Log frequencies of words and of n-grams of each length, by their hashes."""

    languages: list[str]
    prior: np.ndarray
    known: LogTable
    grams: dict[int, LogTable]

    @property
    def words(self) -> np.ndarray:
        return self.known.keys

    @property
    def word_logs(self) -> np.ndarray:
        return self.known.logs

    def _unseen(self, words: list[bytes]) -> np.ndarray:
        """Backed-off log scores of words that training did not see."""
        out = np.zeros((len(words), len(self.languages)))
        todo = np.arange(len(words))
        for n in sorted(self.grams, reverse=True):
            if not len(todo):
                break
            g, text = _grams(_marked([words[i] for i in todo.tolist()]), n)
            one, where = np.unique(g, return_inverse=True)
            at, known = self.grams[n].find(one)
            logs = self.grams[n].rows(at[known])
            row, known = (np.cumsum(known) - 1)[where], known[where]
            got = np.bincount(text[known], minlength=len(todo))
            for k in range(len(self.languages)):
                total = np.bincount(text[known], weights=logs[row[known], k], minlength=len(todo))
                out[todo, k] += np.where(got > 0, total / np.maximum(got, 1), 0.0)
            todo = todo[got == 0]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each whole text."""
        batch = TextBatch(_lower(texts))
        letters = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        if not self.languages:
            return ["und"] * batch.n, np.zeros(batch.n)
        total = np.tile(self.prior, (batch.n, 1))
        starts, ends = batch.words(_LETTERS)
        if len(starts):
            keys, one, where = np.unique(batch.hashes(starts, ends), return_index=True, return_inverse=True)
            logs = np.zeros((len(keys), len(self.languages)))
            at, known = self.known.find(keys)
            logs[known] = self.known.rows(at[known])
            if not known.all():
                data = batch.buf.tobytes()
                new = one[~known]
                logs[~known] = self._unseen([data[a:z] for a, z in zip(starts[new].tolist(), ends[new].tolist())])
            text = batch.text_of(starts)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(text, weights=logs[where, k], minlength=batch.n)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[k] if has else "und" for k, has in zip(best.tolist(), letters)], np.where(letters, p[np.arange(batch.n), best], 0.0)


def _log_table(key: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int) -> LogTable:
    """Smoothed log frequencies from the counts of distinct (key, language) pairs."""
    order = np.lexsort((lang, key))
    key, lang, n = key[order], lang[order], n[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.bincount(lang, weights=n, minlength=languages) + 0.5 * (len(edge) + 1)
    return LogTable(key[edge], np.append(edge, len(key)), lang, np.log((n + 0.5) / total[lang]), np.log(0.5 / total))


#: Most different values of ``lang``: one row for each comes to the driver.
MAX_LANGUAGES = 10_000


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, max_docs: int = 2_000, longest: int = 4, max_total: int = 100_000) -> LanguageModel:
    """Model from the rows with a language, outside the held-out fold: from about ``max_docs`` texts of each language, and
    ``max_total`` of all (beyond 50 languages each has its share of these), which bounds the model that is broadcast."""
    own = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(F.coalesce(fold("doc_id", folds), F.lit(0)) != held_out)
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: lang holds something else")
    max_docs = min(max_docs, max(1, max_total // max(1, len(languages))))
    if not languages:
        return LanguageModel([], np.zeros(0), _log_table(np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0), 0), {})
    share = F.create_map(*[x for v, n in sizes.items() for x in (F.lit(v), F.lit(share_of_draws(max_docs, n)))])
    # rows without an id are told apart by their texts; equal rows count once, so no group of copies breaks the bound
    sample = own.filter(draw("doc_id", "text") < share[F.col("lang")]).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            batch = TextBatch(_lower(b.column("text")))
            starts, ends = batch.words(_LETTERS)
            if not len(starts):
                continue
            lang = pc.dictionary_encode(b.column("lang"))
            code = lang.indices.to_numpy(zero_copy_only=False)[batch.text_of(starts)].astype(np.uint64)
            h = batch.hashes(starts, ends)
            order = np.lexsort((code, h))
            edge = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (code[order][1:] != code[order][:-1])))
            one, n = order[edge], np.diff(np.append(edge, len(order)))
            words, lang_of = [batch.buf[a:z].tobytes() for a, z in zip(starts[one].tolist(), ends[one].tolist())], code[one].astype(np.int64)
            out = [(h[one], lang_of, n, np.zeros(len(n), np.int32))]
            marked = _marked(words)
            for size in range(1, longest + 1):
                g, text = _grams(marked, size)
                pair, where = np.unique(np.stack([g, lang_of[text].astype(np.uint64)], axis=1), axis=0, return_inverse=True)
                out.append((pair[:, 0], pair[:, 1].astype(np.int64), np.bincount(where, weights=n[text], minlength=len(pair)).astype(np.int64), np.full(len(pair), size, np.int32)))
            key, code, n, size = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(np.ascontiguousarray(key).view(np.int64)), lang.dictionary.take(pa.array(code)), pa.array(n, pa.int64())],
                                             names=["size", "key", "lang", "n"])

    code = F.create_map(*[x for i, v in enumerate(languages) for x in (F.lit(v), F.lit(i))])
    counts = (sample.mapInArrow(count, "size int, key long, lang string, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
              .select("size", "key", code[F.col("lang")].alias("lang"), "n").persist())
    try:
        tables = {}
        for size in range(longest + 1):
            rows = counts.filter(F.col("size") == size).select("key", "lang", "n").toArrow()
            tables[size] = _log_table(np.asarray(rows.column("key")).view(np.uint64), np.asarray(rows.column("lang")).astype(np.int16), np.asarray(rows.column("n")), len(languages))
    finally:
        counts.unpersist()
    prior = np.log(np.array([sizes[v] for v in languages], float) / sum(sizes.values()))
    return LanguageModel(languages, prior, tables.pop(0), tables)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, p = sent.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
