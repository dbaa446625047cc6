"""Every query over the whole small tables against its SQL or a plain repetition, and the pipeline stage by stage."""

import math
import os
import re
import sys
import zlib
from collections import Counter

import corpus_pipeline
import helpers as H
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from tillroll.llm import language, language_model, quality, queries, toxicity
from tillroll.llm.common import table
from tillroll.llm.words import TextBatch

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(E.__file__)), "scripts"))
from check_oracle import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# queries with SQL

@pytest.mark.parametrize("name", sorted(queries.llm_oracle_sql()))
def test_query_matches_its_sql(spark, name):
    df, res = E.queries()[name](spark, SF), duck(SF).execute(E.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, res.fetchall())


# 1 toxicity

def clause_mass(model, text):
    """Sum over clauses, every insult and threat weighed by what stands before it."""
    mass = 0.0
    for clause in re.split(r"[.;:!?\n]", toxicity.plain(pa.array([text]))[0].as_py()):
        words = re.findall(r'"|[a-z\'\u0080-\U0010ffff]+', clause)
        for i, w in enumerate(words):
            near, weight = words[max(0, i - 3):i], model.insults.get(w)
            threat = weight is None and w in model.threats
            if weight is None and not threat:
                continue
            weight = model.threats[w] if threat else weight
            is_n, is_t, is_r = (lambda v: v in toxicity.NEGATIONS), (lambda v: v in toxicity.TARGETS), (lambda v: v in toxicity.REPORTS or v == '"')
            if not threat and any(v in model.insults for v in words[:i]):
                weight *= 0.5
            if any(map(is_n, near)):
                weight *= 0.1
            if any(map(is_r, words[:i])):
                weight *= 0.5
            weight *= 1.5 if any(map(is_t, near)) else 0.3 if threat else 1.0
            mass += weight
    return mass


def plain_score(model, text):
    return 1 / (1 + math.exp(-(model.slope * math.log1p(clause_mass(model, text or "")) + model.bias)))


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_toxicity_scores_equal_plain_ones(spark, documents, toxic_model):
    got = by_id(queries.op1_toxicity(spark, SF))
    assert len(got) == len(documents)
    for d, text in [*documents]:
        assert got[d].score == pytest.approx(plain_score(toxic_model, text), abs=1e-9)
        assert got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (H.fold(d, 5) == 0)
    rude = ["you idiot", "he said you are an idiot", "not an idiot", "kill you. you kill", "they will not kill time", 'the "idiot" of them', "idiots idiot IDIOT!", "Du Trottel", "tu n'es pas un crétin", "él dijo basura", "nicht dumb idiot"]
    for t, (m, _) in zip(rude, [toxic_model.masses(pa.array([t])) for t in rude]):
        assert m[0] == pytest.approx(clause_mass(toxic_model, t))


# 2, 4, 7

def test_repeats_query_equals_brute_force(spark, documents):
    H.same_rows(queries.op2_suffix_dedup(spark, SF), H.repeats(documents))


def check_pieces(pieces, texts, window=2048):
    """Pieces hold every id once, in order, in gapless sequences with little padding."""
    t = Tokenizer.from_file(TOKENIZER)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts}
    seen, placed = {}, {}
    for r in pieces:
        seen.setdefault(r.doc_id, []).append(r)
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen) == set(ids)
    for d, own in seen.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert zlib.crc32(np.array(ids[d][at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    for k, parts in placed.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or k == max(placed)
    assert sorted(placed) == list(range(len(placed)))


def test_packing_query_holds_every_id_once(spark, documents):
    check_pieces(queries.op4_packing(spark, SF).collect(), documents)


def test_sharding_query_keeps_its_law(spark, documents):
    got = queries.op7_sharding(spark, SF).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {r.law for r in got} == {"rows"}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


# 3 language model

def test_language_model_scores_equal_plain_ones(spark, documents):
    scores, model = language_model.score_corpus(table(spark, SF, "documents"))
    got = by_id(queries.op3_language_model(spark, SF))
    start, end = object(), object()
    texts = {d: [*H.words(t), end] for d, t in documents}
    one, two = Counter(), Counter()
    training = [d for d in texts if H.fold(d, 5) != 1]
    for d in training:
        one.update(texts[d])
        two.update(zip([start, *texts[d]], texts[d]))
    one_of = lambda c: len(training) if c is start else one[c]
    total = sum(one.values())
    for d, words in texts.items():
        base, score = 0.0, 0.0
        for before, w in zip([start, *words], words):
            n = one_of(before)
            row = model.weights[0 if not n else 1 + int(math.floor(math.log2(n)))]
            p = row[0] * (two[before, w] / n if n else 0) + row[1] * one[w] / total + row[2] / (len(one) + 1)
            score += math.log10(p)
            base += math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1)))
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(one[w] > 0 for w in words), total, H.fold(d, 5) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert np.allclose(model.weights.sum(axis=1), 1)


# 8 quality

def plain_statistics(text):
    t = text or ""
    words, lines = re.split("[ \n]+", t), t.split("\n")
    out = {"chars": math.log1p(len(t)), "words": math.log1p(len(words)), "word_length": len(t) / len(words), "distinct_words": len(set(words)) / len(words),
           "lines": len(lines) / len(words), "distinct_lines": len(set(lines)) / len(lines)}
    return out | {k: sum(c in chars for c in t) / max(len(t), 1) for k, chars in quality.CHARACTER_SETS.items()}


def test_quality_scores_equal_plain_ones(spark, documents):
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = by_id(queries.op8_quality(spark, SF))
    assert len(got) == len(documents)
    for d, text in documents:
        s = plain_statistics(text)
        holds = [all((s[k] > at) == greater for k, greater, at in rule.tests) * w for rule, w in model.rules]
        want = model.constant if model.constant is not None else 1 / (1 + math.exp(-(model.bias + sum(holds))))
        assert got[d].score == pytest.approx(want, abs=1e-9) and got[d].predicted == (got[d].score >= 0.3) and got[d].held_out == (H.fold(d, 5) == 0)


# 9 nearest neighbours

def test_neighbours_query_recalls_most(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None}
    ids = sorted(rows)
    unit = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    got = {}
    for r in queries.op9_nearest(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        s = unit @ unit[ids.index(q)]
        order = [ids[k] for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(r.score - s[ids.index(r.vec_id)]) < 1e-12 for r in found.values())
        hits += len({r.vec_id for r in found.values()} & set(order))
    assert hits >= 0.9 * 5 * len(got)


# 10 language

def plain_language(model, text):
    """Posterior by adding, word by word, the known word's logs or those of its longest known n-grams."""
    def logs(part, size):
        b = TextBatch(pa.array([part], pa.string()))
        h = b.hashes(b.starts, b.ends)
        t = model.known if size == 0 else model.grams[size]
        at, known = t.find(h if size == 0 else h ^ np.uint64(size))
        return t.rows(at)[0] if known[0] else None

    total = np.array(model.prior, float)
    for w in re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower()):
        own = logs(w, 0)
        marked = "\x02" + w + "\x03"
        for n in sorted(model.grams, reverse=True):
            if own is not None:
                break
            found = [x for i in range(len(marked) - n + 1) if (x := logs(marked[i:i + n], n)) is not None]
            own = np.mean(found, axis=0) if found else None
        if own is not None:
            total = total + own
    p = np.exp(total - total.max())
    return model.languages[int(np.argmax(p))], float((p / p.sum()).max())


def test_language_predictions_equal_plain_ones(spark, documents):
    model = language.train(table(spark, SF, "documents"))
    got = by_id(queries.op10_language_id(spark, SF))
    assert len(got) == len(documents)
    for d, text in documents[:60]:
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        name, p = plain_language(model, text)
        assert got[d].lang_pred == name and got[d].score == pytest.approx(p, abs=1e-6) and got[d].held_out == (H.fold(d, 4) == 2)


# the pipeline

def without_repeats(rows, length, words, long_bytes=400):
    """Texts without the repeated runs that have so many words or bytes, by a table of all strings."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, text), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(gone)):
            if m.end() - m.start() < long_bytes and len(d[m.start():m.end()].split()) < words:
                gone[m.start():m.end()] = bytes(m.end() - m.start())
        out.append((doc, bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore") if any(gone) else text))
    return out


def test_pipeline_equals_its_stages_in_plain_python(spark, documents, benchmark, toxic_model):
    rows = [(d, t) for d, t in documents if plain_score(toxic_model, t) < 0.5]
    kept, docs = {}, table(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        kept[name] = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert kept["toxicity"] == sorted(rows) and len(rows) < len(documents)
    rows = [(d, t) for (d, t), g in zip(rows, H.jaccard_groups(rows)) if d == g[2]]
    assert kept["near_duplicates"] == sorted(rows)
    rows = without_repeats(rows, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
    assert kept["repeated_strings"] == sorted(rows)
    rows = [(d, t) for (d, t), c in zip(rows, H.contamination(rows, benchmark)) if not c[5]]
    assert kept["decontamination"] == sorted(rows)
    check_pieces(corpus_pipeline.run(spark, SF).collect(), rows)
