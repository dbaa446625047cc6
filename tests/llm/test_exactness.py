"""Structured strings, large numbers, null and repeated ids, many blocks, clashing names: nothing is confused, capped or dropped."""

import math
import random

import corpus_pipeline
import helpers as H
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, jaccard_join, language, language_model, multi_index, packing, toxicity
from tillroll.llm.components import components, smallest, union
from tillroll.llm.words import TextBatch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


# hashes

@pytest.mark.parametrize("size", [1024, 4096])
def test_regular_strings_have_different_hashes(size):
    """Sums of powers modulo 2**64 alone cannot tell a string of this kind from its complement."""
    a, b = thue_morse(size, "ab"), thue_morse(size, "ba")
    batch = TextBatch([a, b, a])
    h = batch.hashes(batch.starts, batch.ends)
    assert h[0] != h[1] and h[0] == h[2]


def test_regular_words_keep_their_own_ids_and_sets(spark):
    from tokenizers import Tokenizer

    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    t = Tokenizer.from_file(TOKENIZER)
    flat, counts = packing.WordIds(TOKENIZER).ids(pa.array([a, b]))
    want = [t.encode(x, add_special_tokens=False).ids for x in (a, b)]
    assert flat.tolist() == want[0] + want[1] and counts.tolist() == [len(w) for w in want]
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")]
    H.same_rows(jaccard_join.jaccard_components(H.docs(spark, rows)), H.jaccard_groups(rows))
    own = language_model.Tokens(pa.RecordBatch.from_pydict({"text": [a, b]}))
    assert len(np.unique(own.token)) == 3
    items = H.benchmark(spark, [(7, f"{b} {rest}", 0)])
    for block in (8 << 20, 10):
        H.same_rows(decontaminate.decontaminate(H.docs(spark, rows), items, block_bytes=block), H.contamination(rows, [(7, f"{b} {rest}")]))


# nearest neighbours

def test_cosines_of_numbers_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (2, [1e200, 2e200]), (1, [1.0, 1.0]), (4, [1.0, 0.0]), (5, [1e-320, 1e-320]), (6, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 12)) for r in multi_index.search(df, "vec_id = 0").orderBy("rank").collect()]
    assert sorted(got[:2]) == [(1, 1.0), (5, 1.0)] and got[2:] == [(2, round(3 / math.sqrt(10), 12)), (4, round(math.sqrt(0.5), 12)), (6, 0.0)]
    one = spark.createDataFrame([(0, [2.0]), (1, [-3.0]), (2, [0.5]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in multi_index.search(one, "vec_id = 0").orderBy("rank").collect()] == [(2, 1.0), (1, -1.0)]


def test_balanced_rows_have_the_same_cosines():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 9)), rng.normal(size=9)
    plain = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt(float((q * q).sum())))
    assert (multi_index.cosine(x, q) == plain).all()


def test_any_share_of_rows_can_be_queries(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = multi_index.search(df.repartition(6), "vec_id >= 0", k=2, centroids=4, probe=1.0, block_queries=32)
    assert got.count() == 600 and got.select("query_id").distinct().count() == 300


# samples

def test_null_and_repeated_ids_do_not_break_the_samples_bounds(spark):
    nulls = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    model = language.train(nulls, max_docs=10)
    assert 1 <= len(model.words) <= 60
    same = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("xx").alias("lang"))
    own = language.train(same, max_docs=10)
    assert len(own.words) in (0, 2)
    docs = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert 0 < toxicity.training_sample(docs, labels, "toxic", 20).count() < 80
    copies = docs.withColumn("text", F.lit("same")).unionByName(docs.limit(3))
    assert toxicity.training_sample(copies, labels, "toxic", 20).count() == 4


def test_many_languages_share_the_bound(spark):
    rows = spark.range(4_000).select("id", F.concat(F.lit("l"), F.col("id") % 40).alias("lang"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    model = language.train(rows, max_docs=2_000, max_total=400)
    assert len(model.languages) == 40
    n = int((model.known.logs != 0).sum())
    assert n < 1_200


def test_every_word_with_evidence_is_learnt(spark):
    """No cap on learnt words: 2,600 insults, each in four different contexts of toxic texts."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    insults = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(2_600)]
    word = lambda: "".join(rng.choice(letters) for _ in range(4))
    toxic, at = [], [w for w in insults for _ in range(16)]
    rng.shuffle(at)
    for i in range(0, len(at), 40):
        toxic.append(" ".join(f"{word()} {w}" for w in at[i:i + 40]))
    clean = [" ".join(word() for _ in range(400)) for _ in range(400)]
    sample = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, y int")
    learnt = toxicity.learn_lexicon(sample)
    assert len(set(learnt) & set(insults)) > 2_500


# decontamination by rows

def benchmark_and_documents():
    rng = random.Random(9)
    items = [(i, H.prose(rng, rng.randrange(1, 60), 3_000)) for i in range(120)] + [(None, H.prose(rng, 30, 3_000)), (500, ""), (501, None), (3, H.prose(rng, 20, 3_000))]
    rows = []
    for i in range(200):
        text = H.prose(rng, rng.randrange(0, 120), 3_000)
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "x").split()
            a = rng.randrange(len(w)) if w else 0
            text += " " + " ".join(w[a:a + rng.randrange(10, 40)]) + " " + H.prose(rng, 5, 3_000)
        rows.append((i, text))
    hot = items[0][1]
    rows += [(300 + i, hot + " " + H.prose(rng, 3, 3_000)) for i in range(100)] + [(None, hot), (7, hot), (7, hot), (8, None), (9, "")]
    return rows, items


def test_fifty_blocks_of_benchmark_take_three_reads(spark):
    rows, items = benchmark_and_documents()
    own = [i for i in items if i[0] is not None]
    size = sum(len((t or "").encode()) for _, t in own)
    docs, read = H.docs(spark, rows).repartition(4).select("doc_id", "text").cache(), spark.sparkContext.accumulator(0)
    docs.count()

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    counted = docs.mapInArrow(count, docs.schema)
    got = decontaminate.decontaminate(counted, H.benchmark(spark, [(i, t, 0) for i, t in own]), block_bytes=size // 50)
    H.same_rows(got, H.contamination(rows, own))
    assert read.value <= 3 * len(rows)


def test_nameless_items_and_clashing_columns(spark):
    rows, items = benchmark_and_documents()
    bench = H.benchmark(spark, [(i, t, 0) for i, t in items])
    docs = H.docs(spark, rows)
    for c in ("digest", "d", "bad", "gram", "words", "items"):
        docs, bench = docs.withColumn(c, F.lit("clash")), bench.withColumn(c, F.lit("clash"))
    small, large = (decontaminate.decontaminate(docs, bench, block_bytes=b) for b in (8 << 20, 100))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(small) == key(large)
    kept = [decontaminate.drop_contaminated(docs, bench, block_bytes=b) for b in (8 << 20, 100)]
    assert kept[0].columns == kept[1].columns == docs.columns
    assert key(kept[0]) == key(kept[1]) and 0 < kept[0].count() < len(rows)


def test_filter_never_denies_what_it_holds(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(-(1 << 63), 1 << 63, 5_000, dtype=np.int64)
    table = decontaminate.Filter(spark.createDataFrame([(int(x),) for x in g], "gram long"), "gram", most_bits=1 << 16)
    assert table.may_have(g.view(np.uint64)).all()
    other = rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    assert table.may_have(other.view(np.uint64)).mean() < 0.2


# near duplicates

def test_one_row_of_each_group_whatever_its_id(spark):
    rng = random.Random(7)
    base = H.prose(rng, 80)
    near = base.split()
    near[40] = "changed"
    other = H.prose(rng, 60)
    rows = [(None, base), (None, base), (5, " ".join(near)), (5, other), (6, base), (None, H.prose(rng, 50)), (2, other), (9, None), (9, None), (8, ""), (None, " \n")]
    docs = H.docs(spark, rows).withColumn("_first", F.lit("a")).withColumn("_twin", F.lit("b")).withColumn("row", F.lit(1)).withColumn("payload", F.lit("c"))
    got = jaccard_join.keep_one_per_group(docs.repartition(3))
    assert got.columns == docs.columns
    want = [(5, " ".join(near)), rows[5], (2, other), (9, None), (9, None), (8, ""), (None, " \n")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))
    assert jaccard_join.keep_one_per_group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 8_192])
def test_hot_shingles_in_pieces_give_the_same_groups(spark, hot, monkeypatch):
    plain = jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda c, s, rounds=1, tasks=None: plain(c, s, rounds, hot=hot, tasks=tasks))
    rng = random.Random(8)
    base = H.prose(rng, 60)
    rows = [(i, " ".join([*base.split()[:50 + i % 9], *H.prose(rng, 8).split()])) for i in range(60)] + [(100 + i, H.prose(rng, 40)) for i in range(20)]
    H.same_rows(jaccard_join.jaccard_components(H.docs(spark, rows)), H.jaccard_groups(rows))


@pytest.mark.parametrize("per_task", [3, 40, 10**6])
def test_components_in_many_tasks(spark, per_task):
    rng = random.Random(per_task)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1_000, 1_000 + i) for i in range(1, 200)] + [(2_000 + i, 2_001 + i) for i in range(80)]
    u, v = (np.array(x) for x in zip(*links))
    label = smallest(u, v, 3_000)
    want = {int(x): int(label[x]) for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7), per_task=per_task).collect()}
    assert got == want
    named = [(f"n{a:04d}".encode(), f"n{b:04d}".encode()) for a, b in links]
    node, root = union(pa.array([a for a, _ in named]), pa.array([b for _, b in named]))
    assert dict(zip(node.to_pylist(), root.to_pylist())) == {f"n{x:04d}".encode(): f"n{label[x]:04d}".encode() for ab in links for x in ab}


# stages

def test_stages_keep_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i, H.prose(rng, 90)) for i in range(12)] + [(None, H.prose(rng, 40)), (13, None)]
    docs = H.docs(spark, rows)
    for c in ("_first", "_twin", "digest", "doc", "kept", "payload", "y", "label"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == len(rows), name
