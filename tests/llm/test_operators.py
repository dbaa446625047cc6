"""The ten operators on awkward rows, against brute force, round trips or planted cases."""

import hashlib
import random
import zlib

import corpus_pipeline
import helpers as H
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, jaccard_join, language, language_model, multi_index, packing, quality, sharding, suffix_dedup, toxicity
from tillroll.llm.common import DRAWS, share_of_draws

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ROWS = H.texts()


@pytest.fixture(scope="module")
def docs(spark):
    return H.docs(spark).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return H.docs(spark, [])


def labelled(spark, n=400):
    """Documents of two kinds: toxic ones carry insults (one of them unknown to the seeds), poor ones shout."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        toxic, poor = i % 7 == 0, i % 5 == 0
        w = ["".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(60)]
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "grumblewort"]))
        rows.append((i, " ".join(w).upper() + "!!!" if poor and not toxic else " ".join(w)))
        labels.append((i, 0 if poor and not toxic else 1, int(toxic)))
    return H.docs(spark, rows), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (n + 5, None, None)], H.LABELS)


# 1 toxicity

def test_grammar_weighs_clauses_not_words():
    m = toxicity.ToxicityModel({"idiot": 1.0}, {"kill": 1.0})
    m.prepare()
    w = lambda t: m.masses(pa.array([t]))[0][0]
    assert w("you idiot") > w("an idiot") > w("he said she was an idiot") > 0
    assert w("you are not an idiot") < 0.3 < w("not now. an idiot")
    assert w("I will kill you") < w("you kill") and w("kill time") < 0.5
    assert w("idiotic clownery") == w("") == 0 and m.masses(pa.array([None], pa.string()))[0][0] == 0
    assert w("IDIOT. Idiot! idiot?") == pytest.approx(3 * w("idiot"))


def test_typographic_marks_part_words():
    m = toxicity.ToxicityModel({"idiot": 1.0, "élégant": 1.0, "मूर्ख": 1.0}, {})
    w = lambda t: m.masses(pa.array([t]))[0][0]
    one = w("idiot")
    assert one == 1
    for t in ("idiot’", "‘idiot’", "idiot…", "an—idiot—no", "idiot\u00a0!", "idiot\u202f?", "idiot。", "idiot！", "l’idiot", "l'idiot", "'idiot'", "idiot’s",
              "❤\ufe0fidiot", "1\ufe0f\u20e3idiot", "idiot😀", "id\u00adiot", "idiot\u200byou", "¡idiot!", "idiot、", "IDIOT；", "²idiot", "idiot\ufeff", "élégant…", "मूर्ख।"):
        assert w(t) == one, t
    assert w("« idiot\u00a0»") == w("“idiot”") == w("„idiot“") == w('"idiot"') == 0.5
    assert w("don’t, idiot") == w("don't, idiot") == w("no idiot") < 0.3
    for stop in "。．！？；：…؟۔\u2028":
        assert w(f"not{stop}idiot") == one, stop
    assert w("idiotique") == w("éidiot") == w("idioté") == w("idiot\u0301") == 0
    assert w("you’re an idiot") == w("you are an idiot")


def test_insults_next_to_typographic_marks_are_learnt(spark):
    train, labels = labelled(spark)
    marked = train.withColumn("text", F.regexp_replace("text", "grumblewort", "l’grumblewort…"))
    assert toxicity.train(marked, labels).insults["grumblewort"] > 0


def test_composition_multiplies_factors():
    a, b = toxicity._near("N", "I", 0.5, 2), toxicity._after("R", "I", 0.25)
    ab = (a @ b).compiled()
    state, factors = ab.start, []
    for s in "RNIooI":
        state, f = ab.step(state, s)
        factors.append(f)
    assert factors == [1, 1, 0.125, 1, 1, 0.25]


def test_toxicity_learns_and_handles_awkward_rows(spark, docs, none):
    train, labels = labelled(spark)
    model = toxicity.train(train, labels)
    assert model.insults["grumblewort"] > 0
    got = {r.doc_id: r for r in toxicity.score(train, model).collect()}
    assert all(got[i].predicted == (i % 7 == 0) for i in range(400))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored) and not any(r.predicted for r in scored)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == len(ROWS)
    blank = toxicity.train(none, spark.createDataFrame([], H.LABELS))
    assert toxicity.score(H.docs(spark, [(1, "you idiot, moron")]), blank).first().predicted == 1


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    train, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(train, labels) == toxicity.train(train, flipped)


# 2 repeated strings

def test_repeats_equal_brute_force(spark, docs, none):
    got = suffix_dedup.dedup_report(docs)
    H.same_rows(got, H.repeats(ROWS))
    assert suffix_dedup.dedup_report(none).count() == 0


def test_hot_anchors_give_the_same_rows(spark):
    rng = random.Random(5)
    passage = H.prose(rng, 130)
    rows = [(i, H.prose(rng, rng.randrange(40)) + " " + passage + " " + H.prose(rng, rng.randrange(40))) for i in range(40)]
    rows += [(50 + i, passage[i * 7:i * 7 + 420]) for i in range(20)]
    own = H.docs(spark, rows).select("doc_id", "text")
    for hot in (3, 4096):
        H.same_rows(suffix_dedup.cut_repeats(own, hot=hot).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), H.repeats(rows))


def test_planted_passages_of_over_fifty_words_go(spark):
    """Passages of 51 to 70 words, also short ones, go from all documents that share them; clean documents and shorter quotations stay."""
    rng = random.Random(12)
    word = lambda a, z: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(a, z)))
    prose = lambda n, a=2, z=9: " ".join(word(a, z) for _ in range(n))
    passages = [prose(rng.randrange(51, 71), 2, 3 + i % 6) for i in range(40)]
    quotes = [prose(40, 2, 8) for _ in range(10)]
    rows, planted, quoted = [], [], []
    for i in range(120):
        p = passages[i % 40]
        rows.append((i, f"{prose(60)} {p} {prose(50)}"))
        planted.append(p)
    for i in range(20):
        rows.append((200 + i, f"{prose(60)} {quotes[i % 10]} {prose(50)}"))
        quoted.append(quotes[i % 10])
    rows += [(300 + i, prose(150)) for i in range(40)]
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, H.docs(spark, rows).repartition(3), "").collect()}
    assert not [i for i, p in enumerate(planted) if any(p[k:k + 100] in got[i] for k in range(0, len(p) - 100, 20))]
    assert all(len(got[i]) >= len(rows[i][1]) - len(p) - 6 for i, p in enumerate(planted))  # what is around a passage stays
    assert all(got[i] == t for i, t in rows if i >= 200)


def test_remove_repeats_keeps_rows_and_columns(spark, docs, none):
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema.names == docs.schema.names and out.count() == len(ROWS)
    want = {(d, b - r) for d, b, r, *_ in H.repeats(ROWS) if d != 12}
    assert {(r.doc_id, len((r.text or "").encode())) for r in out.collect() if r.doc_id != 12} == want
    assert out.filter("doc_id = 0").first().text is None and suffix_dedup.remove_repeats(none).count() == 0


# 3 language model

def test_base_scores_and_better_than_base(spark, docs, none):
    rng = random.Random(6)
    phrases = [H.prose(rng, 6, 3000) for _ in range(60)]
    rows = ROWS + [(1000 + i, " ".join(rng.choice(phrases) for _ in range(20))) for i in range(150)]
    scores, model = language_model.score_corpus(H.docs(spark, rows).repartition(3))
    got = scores.collect()
    count = {}
    for d, t in rows:
        if d is None or H.fold(d, 5) != 1:
            for w in [*H.words(t), None]:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    assert (model.tokens, model.vocabulary) == (total, len(count))
    smooth = np.log10(total + 0.5 * (len(count) + 1))
    want = sorted((d is None, d or 0, len(H.words(t)) + 1, sum(w in count for w in [*H.words(t), None]),
                   round(sum(np.log10(count.get(w, 0) + 0.5) - smooth for w in [*H.words(t), None]), 6)) for d, t in rows)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    own = [r for r in got if (r.doc_id or 0) >= 1000 and r.role == language_model.TEST]
    assert own and all(r.score > r.base_score for r in own)
    assert np.allclose(model.weights.sum(axis=1), 1) and model.weights[0, 0] == 0
    assert language_model.score_corpus(none)[0].count() == 0
    one, _ = language_model.score_corpus(H.docs(spark, [(next(i for i in range(99) if H.fold(i, 5) == 1), "a b")]))
    assert one.first().score == 0


def test_mixture_probabilities_sum_to_one():
    tokens = language_model.Tokens(pa.RecordBatch.from_pydict({"text": ["a b a c", "a b", None]}))
    total = np.bincount(np.concatenate([tokens.token, tokens.pair]), minlength=len(tokens.keys))
    words = (tokens.keys & np.uint64(1)) == 0
    assert total[words].sum() == 9 and words.sum() == 4
    assert (language_model.context_bucket(np.array([0, 1, 2, 3, 4, 7, 8])) == [0, 1, 2, 2, 3, 3, 4]).all()


def test_weights_find_the_better_estimate():
    events = [(3, -10, -60, 900), (3, language_model._ZERO, -40, 100), (5, language_model._ZERO, -40, 500)]
    w = language_model.learn_weights(events, 1e-5)
    assert w[3, 0] > 0.7 and w[5, 0] < 0.05 and w[5, 1] > 0.9


# 4 packing

def test_packing_equals_the_tokenizer(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER, window=64).collect()
    ids = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]
    seen = {}
    for r in pieces:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in seen.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(seen)
    assert sorted(seen) == list(range(len(seen)))
    want = {}
    for d, text in ROWS:
        want.setdefault(d, []).append(ids(text))
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, texts in want.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, texts))
        if len(texts) == 1:
            for r in by_doc[d]:
                part = np.array(texts[0][r.start:r.start + r.length], dtype="<u4")
                assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(texts[0])
    assert packing.pack(none, TOKENIZER).count() == 0


def test_word_memory_starts_anew_without_changing_ids():
    texts = pa.array(["alpha, beta. gamma", "Beta   deltá it's", "x1y2 ,. ... ß", None])
    small, large = packing.WordIds(TOKENIZER, max_words=2), packing.WordIds(TOKENIZER)
    for _ in range(2):
        a, b = small.ids(texts), large.ids(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        want = [large.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
        assert a[0].tolist() == [i for w in want for i in w]


def test_special_tokens_are_the_plain_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = ["hello <|endoftext|> you", "A<|endoftext|>B", "<|ENDOFTEXT|> <|EndOfText|>x", "<|startoftext|><|endoftext|>, End. <|endoftext|>. Z<|endoftext|>Ab.",
             "<|endoftext", "|> It's<|endoftext|>'S", "<|endoftext|>", "É<|startoftext|>É <|endof text|>", None, "THE <|endoftext|><|ENDOFTEXT|>\nthe"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert sum(w.count(49407) for w in want) == 8
    model = packing.WordIds(TOKENIZER)
    for _ in range(2):
        flat, counts = model.ids(pa.array(texts))
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    got = {r.doc_id: r for r in packing.pack(H.docs(spark, list(enumerate(texts))), TOKENIZER).collect()}
    for i, w in enumerate(want):
        assert got[i].doc_tokens == len(w) + 1 and got[i].ids_crc32 == zlib.crc32(np.array([*w, 1], dtype="<u4").tobytes())


# 5 decontamination

ITEMS = [(1, " ".join(H.texts()[8][1].split()[40:70])), (2, "One Two"), (2, "three four five six seven eight nine"), (3, ""), (4, None),
         (5, "same ROW"), (11, H.texts()[9][1]), (12, "aa " * 13)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_contamination_equals_brute_force(spark, docs, none, block_bytes):
    items = H.benchmark(spark, [(i, t, 0) for i, t in ITEMS])
    want = H.contamination(ROWS, ITEMS)
    assert {r[3] for r in want} >= {0, 1, 2}
    H.same_rows(decontaminate.decontaminate(docs, items, block_bytes=block_bytes), want)
    assert decontaminate.decontaminate(none, items, block_bytes=block_bytes).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0), block_bytes=block_bytes).filter("n_hit > 0 or contaminated").count() == 0
    clean = decontaminate.drop_contaminated(docs, items, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want if not r[5])


@pytest.mark.parametrize("block_bytes", [8 << 20, 8])
def test_benchmark_rows_without_an_id(spark, block_bytes):
    items = H.benchmark(spark, [(i, t, 0) for i, t in [(None, "alpha beta"), (7, "alpha beta"), (None, "delta"), (None, "beta gamma"), (8, "nothing")]])
    own = H.docs(spark, [(1, "alpha beta gamma"), (2, "delta eps"), (3, "zeta")])
    sha = lambda names: hashlib.sha256(names.encode()).hexdigest()
    H.same_rows(decontaminate.decontaminate(own, items, block_bytes=block_bytes),
                [(1, 3, 3, 2, sha("7"), True), (2, 2, 1, 1, sha(""), True), (3, 1, 0, 0, sha(""), False)])
    assert [r.doc_id for r in decontaminate.drop_contaminated(own, items, block_bytes=block_bytes).collect()] == [3]


# 6 Jaccard join

def test_jaccard_groups_equal_brute_force(spark, docs, none):
    rows = [r for r in ROWS if r[0] is not None]
    H.same_rows(jaccard_join.jaccard_components(docs.filter("doc_id is not null")), H.jaccard_groups(rows))
    assert jaccard_join.jaccard_components(docs).count() == len(ROWS)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_near_copies_and_borderline_pairs(spark, rounds):
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = H.prose(rng, 60, 5000).split()
        for c in range(8):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((g * 10 + c, " ".join(w[rng.randrange(3):len(w) - rng.randrange(3)])))
    for n in range(6, 30):  # sets that differ by one or two shingles of few
        w = H.prose(rng, n, 5000).split()
        rows += [(1000 + 4 * n, " ".join(w)), (1001 + 4 * n, " ".join(w[:-1])), (1002 + 4 * n, " ".join(w[1:])), (1003 + 4 * n, " ".join(w[:-2]))]
    common = H.prose(rng, 30, 5000)
    rows += [(500 + i, common + " " + H.prose(rng, rng.randrange(4, 14), 5000)) for i in range(25)]
    want = H.jaccard_groups(rows)
    assert 10 < len({r[2] for r in want}) < len(rows)
    H.same_rows(jaccard_join.jaccard_components(H.docs(spark, rows), rounds=rounds), want)


def test_keep_one_per_group(spark, docs):
    out = jaccard_join.keep_one_per_group(docs)
    assert out.columns == docs.columns
    rows = [r for r in ROWS if r[0] is not None]
    first = {r[0] for r in H.jaccard_groups(rows) if r[0] == r[2]}
    kept = [r.doc_id for r in out.collect()]
    assert set(kept) == first | {None} and kept.count(13) == 2 and kept.count(14) == 1


def test_long_prefix_rule_keeps_every_pair():
    sim, rng = jaccard_join.Similarity(75), random.Random(3)
    for _ in range(20_000):
        a = rng.sample(range(10**6), rng.randrange(1, 40))
        b = [x for x in a if rng.random() > 0.08] + rng.sample(range(10**6, 2 * 10**6), rng.choice([0, 0, 1, 2]))
        if not b or not sim.linked(len(set(a) & set(b)), len(a), len(b)):
            continue
        long_ = [set(sorted(s)[:sim.prefix(len(s)) + sim.spare(len(s))]) for s in (a, b)]
        assert all(len(long_[0] & long_[1]) >= sim.least_shared(len(s)) for s in (a, b))


# 7 sharding

def test_shards_are_exact_and_uniform(spark, docs, none):
    out = sharding.shard_documents(docs, 6)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"rows"}
    sizes = [sum(r.shard == s for r in rows) for s in range(6)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(6):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert want == sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(docs, 6).collect()))
    assert sharding.shard_documents(none, 6).count() == 0 and sharding.shard_documents(H.docs(spark, ROWS[:2]), 6).count() == 2


def test_communication_matrix_is_hypergeometric():
    rows, (size, shard, first) = np.array([30, 0, 50, 20]), sharding.bin_sizes(100, 3, 20)
    assert size.sum() == 100 and size.max() <= 20 and (first[shard == 1] >= 0).all()
    mean = np.zeros((4, len(size)))
    for seed in range(400):
        m = np.array([sharding.matrix_row(seed, rows, size, i) for i in range(4)])
        assert (m >= 0).all() and (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == size).all()
        mean += m / 400
    assert np.abs(mean - np.outer(rows, size) / 100).max() < 0.5


def test_hypergeometric_beyond_the_generators_limit():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 6 * 10**9, 10**6
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(300)])
    sd = (n * (1 / 3) * (2 / 3)) ** 0.5
    assert abs(x.mean() - n / 3) < 5 * sd / 300**0.5 and 0.8 < x.std() / sd < 1.2


# 8 quality

def test_rules_separate_and_compile_to_columns(spark, docs, none):
    train, labels = labelled(spark)
    model = quality.train(train, labels)
    assert model.rules and all(str(r) for r, _ in model.rules)
    got = {r.doc_id: r.predicted for r in quality.score(train, model).collect()}
    want = {i: 0 if i % 5 == 0 and i % 7 else 1 for i in range(400)}
    assert sum(got[i] == want[i] for i in want) >= 396
    scored = quality.score(docs, model)
    assert "Python" not in scored._jdf.queryExecution().toString() and "Arrow" not in scored._jdf.queryExecution().toString()
    assert scored.filter("score between 0 and 1").count() == len(ROWS) and quality.score(none, model).count() == 0
    assert quality.train(train, labels.withColumn("quality", F.lit(1))).constant == 1.0
    assert quality.train(none, labels).constant == 0.5


# 9 nearest neighbours

def vectors(n=3000, d=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    x[1000:1400] = x[0]  # a very common vector
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]


def test_neighbours_recall_ties_and_invalid_rows(spark):
    rows = vectors()
    bad = [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] + [1.0] * 15), (9200, [float("inf")] + [1.0] * 15), (9250, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in [*rows, *bad, rows[50]]], "vec_id long, embedding array<float>, shard int, score double")
    got = {}
    for r in multi_index.search(df, "vec_id % 50 = 0", centroids=16, probe=0.5, shard_rows=700, block_queries=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert sorted(got) == list(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len({f[1] for f in found} & set(best.tolist()))
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[0]] == [1000, 1001, 1002, 1003, 1004] and [f[1] for f in got[1000]] == [0, 1001, 1002, 1003, 1004]


def test_neighbours_of_few_or_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert multi_index.search(make([]), "vec_id % 50 = 0").count() == 0
    assert multi_index.search(make([(0, [1.0, 2.0])]), "vec_id % 50 = 0").count() == 0
    got = multi_index.search(make([(0, [1.0, 2.0]), (7, [2.0, 4.0]), (3, [1.0, 2.0])]), "vec_id % 50 = 0").orderBy("rank").collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(3, 1), (7, 2)]


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    books = multi_index.Codebooks(x, 8, 1)
    sizes = np.bincount(books.cell(x), minlength=books.cells)
    order = books.traverse(x[0], sizes, 10**9)
    d = [multi_index.distances(h, c)[0] for h, c in zip(books.halves(multi_index.unit(x[:1])), books.books)]
    sums = (d[0][:, None] + d[1][None]).ravel()[order]
    assert (np.diff(sums) >= -1e-12).all() and sorted(order) == np.flatnonzero(sizes).tolist()


# 10 language

def test_language_words_first_then_shorter_grams(spark, docs, none):
    rng = random.Random(11)
    stems = {"xx": ["kal", "mor", "tin", "sul"], "yy": ["élo", "gru", "vaz", "nip"], "zz": ["中文", "字", "汉语", "高"]}
    word = lambda v, n=2: "".join(rng.choice(stems[v]) for _ in range(n))
    rows = [(i, " ".join(word(v, rng.randrange(1, 3)) for _ in range(30)), v) for i, v in enumerate(["xx", "yy", "zz"] * 40)]
    df = spark.createDataFrame([*rows, (900, "kal", None), (901, None, "xx")], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == ["xx", "yy", "zz"]
    new = [(i, word(v, 4) + " " + word(v, 5), v) for i, v in enumerate(["xx", "yy", "zz"] * 5)]  # unseen words
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == v and 0 <= got[i].score <= 1 for i, _, v in new)
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert {out[i].lang_pred for i in (0, 1, 2, 15)} == {"und"} and out[3].lang_pred in model.languages and language.identify(docs, model).count() == len(ROWS)
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(none)).collect()} == {"und"}


def test_language_of_the_held_out_fold_does_not_matter(spark):
    df = H.docs(spark, [(i, H.prose(random.Random(i), 20, 50)) for i in range(120)])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = df.withColumn("lang", F.when(held, F.lit("qq")).otherwise(F.col("lang")))
    a, b = language.train(df), language.train(other)
    assert a.languages == b.languages and (a.words == b.words).all() and np.allclose(a.word_logs, b.word_logs)


def test_language_model_keeps_every_word_of_every_language(spark):
    rng, ids = random.Random(12), [i for i in range(200) if H.fold(i, 4) != 2]
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(i, " ".join(2 * [word() for _ in range(700)]), "xx") for i in ids[:100]] + [(ids[100], "zorvek", "yy")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {w for _, t, _ in rows for w in t.split()}
    assert len(seen) > 60_000 and len(model.words) == len(seen)
    grams = {f"<{w}>"[k:k + 4] for w in seen for k in range(len(w) - 1)}
    assert len(model.grams[4].keys) == len(grams) and len(model.grams[4].logs) >= len(grams)
    one = language.TextBatch(["zorvek"])
    at, known = model.known.find(one.hashes(one.starts, one.ends))
    assert known.all() and model.known.rows(at)[0].argmax() == model.languages.index("yy")


# samples

def test_samples_do_not_vanish_as_the_input_grows(spark):
    n, wanted = 5_000_000, 4  # less than a millionth
    many = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("kalmor"))
    labels = many.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert 0 < toxicity.training_sample(many, labels, "toxic", wanted).count() < 5 * wanted
    rows = many.withColumn("lang", F.lit("xx")).union(spark.createDataFrame([(5, "vaz", "yy")], "doc_id long, text string, lang string"))
    model = language.train(rows, max_docs=wanted)
    word = language.TextBatch(["kalmor"])
    at, known = model.known.find(word.hashes(word.starts, word.ends))
    assert known.all() and model.known.rows(at)[0].argmax() == model.languages.index("xx")
    for size in (10**3, 10**7, 10**11, 10**17):
        assert abs(share_of_draws(2_000, size) * size / DRAWS - min(size, 2_000)) < 0.1 * min(size, 2_000)
