"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols: insult (I), threat (H), target (T), negation
(N), reported speech (R); everything else is a filler (o). Five weighted
transducers each read a clause's symbols and put a factor on every insult or
threat: ``insult`` (the first insult of a clause counts in full, further ones by
half), ``threat`` (a threat word counts in full only shortly after a target),
``target`` (a target shortly before), ``negation`` (a negation shortly before) and
``report`` (a reporting verb or a quotation mark earlier in the clause). Their
composition runs all five at once; the weight of a matched clause is the sum over
its insults and threats of word weight times factors. A text's mass is the sum of
its clauses' weights; its score is a logistic of the mass.

The grammar's words and the seed lexicon are English, German, French and Spanish;
words of insult in any language are learnt from labelled texts: a word is learnt
as an insult if its distinct contexts (word before, word after) inside toxic
texts are significantly many for its frequency in clean texts. Counting contexts,
not texts, keeps words that only near-copies of one toxic text share out.

Bounds: at most about ``max_train`` labelled texts (chosen by a hash, so the same at
every run) train the lexicon; every word of theirs with enough evidence is learnt.
Scoring reads every whole text and calls Python only for texts with a trigger.

Typographic quotes, apostrophes and clause ends count as their ASCII forms, all
other characters that are no letters as spaces, in learning and in scoring. An
apostrophe parts words (l'idiot, idiot's) except in n't.

Edge cases. Null and empty texts have mass 0 and the lowest score. Without
labels of both kinds the seed lexicon and a fixed logistic are used. Repeated
label rows for an id: toxic if any says so. Repeated documents: each row has its score.
Very long texts are read whole. Empty tables: no rows. Other columns are ignored, or
kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import draw, fold, share_of_draws
from tillroll.llm.words import TextBatch, byte_class, slices

#: The seed lexicon and the grammar's words, by language.
SEED_INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless",
    "disgusting", "clown", "dumb", "fool", "imbecile", "vermin", "filth",
    "idioten", "dummkopf", "trottel", "abschaum", "versager",
    "imbécile", "crétin", "abruti", "ordure",
    "imbécil", "estúpido", "estúpida", "escoria", "basura")
SEED_THREATS = (
    "kill", "hurt", "destroy", "beat", "stab", "shoot", "burn", "strangle",
    "töte", "umbringen", "erschießen", "verprügeln",
    "tuer", "frapper", "brûler", "étrangler",
    "matar", "golpear", "quemar", "estrangular")
TARGETS = (
    "you", "your", "he", "she", "they", "them", "him", "her", "this", "that", "these", "those",
    "du", "dich", "dir", "euch", "ihr", "ihn", "ihm", "sie",
    "tu", "te", "toi", "vous", "il", "elle", "ils", "elles", "eux",
    "tú", "usted", "ustedes", "él", "ella", "ellos", "ellas")
NEGATIONS = (
    "not", "never", "no", "without", "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't",
    "nicht", "kein", "keine", "nie", "niemals", "ohne",
    "pas", "jamais", "sans", "aucun", "aucune",
    "nunca", "jamás", "sin", "tampoco")
REPORTS = (
    "said", "says", "claimed", "claims", "reported", "quoted", "alleged", "accused", "called", "wrote",
    "sagte", "sagt", "behauptete", "behauptet", "nannte", "schrieb",
    "dit", "disait", "affirme", "prétend", "écrit",
    "dijo", "dice", "afirma", "afirmó", "escribió")

#: What becomes of characters that are neither letters nor ASCII, in this order: invisible ones inside words go,
#: apostrophes, quotation marks and clause ends get their ASCII form, others and marks without a letter are spaces.
_PLAIN = ((r"[\x{ad}\x{200c}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]+", ""),
          (r"[\x{2bc}‘’‚‛′＇]", "'"),
          (r"[“”„‟«»‹›「」『』｢｣〝〞〟＂]", '"'),
          (r"[…。．｡۔।॥։።។။]", "."),
          (r"[！‼⁉]", "!"),
          (r"[？⁇⁈؟]", "?"),
          (r"[；؛\x{37e}]", ";"),
          (r"：", ":"),
          (r"[\x{85}\x{2028}\x{2029}]", "\n"),
          (r"[^\x00-\x7F\p{L}\p{M}]+", " "),
          (r"(^|[^\p{L}\p{M}])\p{M}+", r"\1 "))
_TYPOGRAPHIC = r"\x{2bc}|[^\x00-\x7F\p{L}]"

#: byte class of lexicon words: a-z, the apostrophe and all non-ASCII bytes, in plain texts
_WORD = byte_class([b for b in range(128) if not (97 <= b <= 122 or b == 39)])
_TOKEN = re.compile(r"""[.;:!?\n]|"|[a-z'\u0080-\U0010ffff]+""")


def _replace(texts: pa.Array, where: str, changes) -> pa.Array:
    """The texts with the changes (pattern, replacement) made in those that match ``where``."""
    at = pc.match_substring_regex(texts, where)
    found = texts.filter(at)
    if not len(found):
        return texts
    for pattern, to in changes:
        found = pc.replace_substring_regex(found, pattern, to)
    return pc.replace_with_mask(texts, at, found)


def plain(texts: pa.Array) -> pa.Array:
    """Lower case, with typographic characters as ASCII; apostrophes stay in n't only and part words elsewhere."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = _replace(pc.utf8_lower(pc.fill_null(texts, "")), _TYPOGRAPHIC, _PLAIN)
    return _replace(texts, "'", [(r"(n't\b)|'", r"\1 ")])


class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, factor of the symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition over the same input: states pair up, factors multiply."""
        def step(state, symbol):
            a, f = self.step(state[0], symbol)
            b, g = other.step(state[1], symbol)
            return (a, b), f * g

        return Transducer((self.start, other.start), step)

    def compiled(self) -> Transducer:
        """The same machine with its transitions tabled as they are met (finitely many states)."""
        table: dict = {}
        step = self.step

        def look(state, symbol):
            key = (state, symbol)
            if key not in table:
                table[key] = step(state, symbol)
            return table[key]

        return Transducer(self.start, look)


def _near(trigger: str, on: str, factor: float, reach: int) -> Transducer:
    """Multiply symbols in ``on`` by ``factor`` if ``trigger`` was read at most ``reach`` symbols before."""
    def step(left, symbol):
        f = factor if left and symbol in on else 1.0
        return (reach if symbol == trigger else max(0, left - 1)), f

    return Transducer(0, step)


def _after(trigger: str, on: str, factor: float) -> Transducer:
    """Multiply symbols in ``on`` by ``factor`` if ``trigger`` was read anywhere before in the clause."""
    return Transducer(False, lambda seen, s: (seen or s == trigger, factor if seen and s in on else 1.0))


def grammar(negated: float = 0.1, reported: float = 0.5, targeted: float = 1.5, untargeted_threat: float = 0.3, repeated: float = 0.5, reach: int = 3) -> Transducer:
    """The composed clause grammar."""
    insult = _after("I", "I", repeated)
    negation = _near("N", "IH", negated, reach)
    report = _after("R", "IH", reported)
    target = _near("T", "IH", targeted, reach)
    threat = Transducer(0, lambda left, s: (reach if s == "T" else max(0, left - 1), untargeted_threat if s == "H" and not left else 1.0))
    return (insult @ threat @ target @ negation @ report).compiled()


@dataclass
class ToxicityModel:
    """Lexicon weights (word -> weight), the grammar's factors and the logistic of the mass."""

    insults: dict[str, float]
    threats: dict[str, float]
    slope: float = 6.0
    bias: float = -3.0
    factors: dict = field(default_factory=dict)

    def prepare(self) -> None:
        self._machine = grammar(**self.factors)
        self._symbol = {w: "T" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS}
        self._symbol |= {w: "H" for w in self.threats} | {w: "I" for w in self.insults}
        triggers = sorted({*self.insults, *self.threats})
        b = TextBatch(triggers)
        self._triggers = np.sort(b.hashes(b.starts, b.ends))

    def clause_weight(self, words: list[str]) -> float:
        state, weight, step = self._machine.start, 0.0, self._machine.step
        for w in words:
            symbol = "R" if w == '"' else self._symbol.get(w, "o")
            state, factor = step(state, symbol)
            if symbol == "I":
                weight += self.insults[w] * factor
            elif symbol == "H":
                weight += self.threats[w] * factor
        return weight

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Matched clauses of a plain text with their weights."""
        out, words = [], []
        for token in [*_TOKEN.findall(text), "."]:
            if token in ".;:!?\n":
                weight = self.clause_weight(words) if words else 0.0
                if weight:
                    out.append((" ".join(words), weight))
                words = []
            else:
                words.append(token)
        return out

    def masses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mass and number of matched clauses of each whole text."""
        if not hasattr(self, "_machine"):
            self.prepare()
        lowered = plain(texts)
        batch = TextBatch(lowered)
        starts, ends = batch.words(_WORD)
        mass, matched = np.zeros(batch.n), np.zeros(batch.n, np.int64)
        if len(starts) and len(self._triggers):
            h = batch.hashes(starts, ends)
            at = np.minimum(np.searchsorted(self._triggers, h), len(self._triggers) - 1)
            for i in np.unique(batch.text_of(starts[self._triggers[at] == h])).tolist():
                found = self.clauses(lowered[i].as_py())
                mass[i], matched[i] = sum(w for _, w in found), len(found)
        return mass, matched

    def scores(self, mass: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(mass) + self.bias)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(text, y) of labelled texts outside the held-out fold, at most about max_train, chosen by a hash.

    Where documents share ids, so that more rows than that carry a chosen label, equal rows
    count once and the different ones are drawn by a hash of id and text.
    """
    known = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("y")).filter("doc_id is not null and y is not null")
             .filter(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y")))
    n = known.count()
    if n > max_train:
        known = known.filter(draw("doc_id") < share_of_draws(max_train, n))
    # the sample has a bounded number of (id, label) rows, so it can go to every task
    sent = F.broadcast(known)
    found = docs.select("doc_id", "text").join(sent, "doc_id")
    rows = docs.select("doc_id").join(sent, "doc_id").count()
    if rows > max_train + max_train // 2:
        found = found.distinct()  # equal rows meet before they are shuffled
        rows = found.count()
        found = found.filter(draw("doc_id", "text") < share_of_draws(max_train, rows))
    return found.select("text", "y")


def learn_lexicon(sample: DataFrame, least_evidence: float = 25.0, least_contexts: int = 4) -> dict[str, float]:
    """Words with far more distinct contexts in toxic texts than their frequency in clean texts suggests, with log-odds weights."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            batch = TextBatch(plain(b.column("text")))
            starts, ends = batch.words(_WORD)
            if not len(starts):
                continue
            h = np.concatenate([[np.uint64(1)], batch.hashes(starts, ends), [np.uint64(2)]])
            word, around = h[1:-1], h[:-2] * np.uint64(3) + h[2:]
            toxic = np.asarray(b.column("y").to_numpy(zero_copy_only=False), dtype=bool)[batch.text_of(starts)]
            at = np.flatnonzero(toxic)
            at = at[np.unique(np.stack([word[at], around[at]], axis=1), axis=0, return_index=True)[1]] if len(at) else at
            _, clean, n = np.unique(word[~toxic], return_index=True, return_counts=True)  # clean words: summed before they travel
            clean = np.flatnonzero(~toxic)[clean]
            data, one = batch.buf.tobytes(), np.concatenate([at, clean])
            words = [data[a:z].decode("utf-8", "replace") for a, z in zip(starts[one].tolist(), ends[one].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([*around[at].view(np.int64).tolist(), *[None] * len(clean)], pa.int64()), pa.array(np.concatenate([np.zeros(len(at), np.int64), n]))],
                names=["word", "around", "n"])

    seen = sample.mapInArrow(contexts, "word string, around long, n long").groupBy("word", "around").agg(F.sum("n").alias("n"))
    by_word = seen.groupBy("word").agg(F.count("around").alias("a"), F.sum("n").alias("b"))
    both = by_word.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not both.a or not both.b:
        return {}
    a, b, share = F.col("a"), F.col("b"), both.a / (both.a + both.b)
    n = a + b
    evidence = 2 * (a * F.log(a / (n * share)) + F.when(b > 0, b * F.log(b / (n * (1 - share)))).otherwise(0.0))
    kept = (by_word.filter((a >= least_contexts) & (a / n > max(0.5, min(0.9, 2 * share)))).withColumn("e", evidence)
            .filter(F.col("e") >= least_evidence).orderBy(F.desc("e"), "word"))
    out = {}
    for r in kept.collect():  # every word that passes; at most those of the bounded sample's toxic texts
        odds = math.log((r.a + 0.5) / (r.b + 0.5)) - math.log(share / (1 - share))
        out[r.word] = min(3.0, max(0.2, odds / 3))
    return out


def fit_logistic(mass: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and bias of label ~ log1p(mass), from counts (Newton steps with a small ridge)."""
    x = np.stack([np.log1p(mass), np.ones_like(mass)], axis=1)
    w = np.array([4.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (n * (p - y)) + ridge * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, label: str = "toxic") -> ToxicityModel:
    """Model from the labelled documents outside the held-out fold."""
    sample = training_sample(docs, labels, label, max_train)
    learnt = learn_lexicon(sample)
    insults = {w: 1.0 for w in SEED_INSULTS} | {w: v for w, v in learnt.items() if w not in TARGETS + NEGATIONS + REPORTS + SEED_THREATS}
    model = ToxicityModel(insults, {w: 1.0 for w in SEED_THREATS})
    blank = ToxicityModel(model.insults, model.threats)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m, _ = blank.masses(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.minimum(m, 30.0), 1)), b.column("y").cast(pa.int32())], names=["mass", "y"])

    rows = sample.mapInArrow(masses, "mass double, y int").groupBy("mass", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 602 rows
    if len({r.y for r in rows}) == 2:
        model.slope, model.bias = fit_logistic(*(np.array([r[k] for r in rows], float) for k in ("mass", "y", "n")))
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents' ids with score, predicted, mass and number of matched clauses."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m, k = sent.value.masses(b.column("text"))
            s = sent.value.scores(m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(m), pa.array(k)],
                                             names=["doc_id", "score", "predicted", "mass", "n_clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, mass double, n_clauses long")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m, _ = sent.value.masses(b.column("text"))
            yield b.filter(pa.array(sent.value.scores(m) < threshold))

    return docs.mapInArrow(run, docs.schema)
