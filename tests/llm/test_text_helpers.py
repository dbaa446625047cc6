"""Vectorised tokenising, chunk tallies, components, and the run-length index against plain Python."""

import random

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import chunks as ch
from tillroll.llm.components import components
from tillroll.llm.run_index import RunIndex
from tillroll.llm.words import ALNUM, NOT_SPACE, TextBatch, ngrams_by_text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_words_equal_the_patterns(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    batch = TextBatch(pa.array(texts, pa.string()), lower=True)
    for table, pattern in ((NOT_SPACE, H.SPACE_WORD), (ALNUM, H.BENCH_WORD)):
        starts, ends = batch.words(table)
        got = [batch.buf[a:z].tobytes().decode() for a, z in zip(starts, ends)]
        assert got == [w for t in texts for w in H.words(t, pattern)]
        assert batch.counts_per_text(starts).tolist() == [len(H.words(t, pattern)) for t in texts]


def test_equal_bytes_have_equal_hashes_and_others_differ():
    rng = random.Random(1)
    words = [rng.choice(["a", "ab", "ba", "aab", "é", "zz"]) for _ in range(500)]
    batch = TextBatch([" ".join(words)])
    starts, ends = batch.words()
    h = batch.hashes(starts, ends).tolist()
    assert len(set(h)) == len(set(words)) and len(set(zip(h, words))) == len(set(words))


def test_ngrams_stay_inside_a_text():
    batch = TextBatch(["a b c", "", "d e", "a b c"])
    starts, ends = batch.words()
    counts = batch.counts_per_text(starts)
    g, text, first = ngrams_by_text(batch.hashes(starts, ends), counts, 3, whole_if_short=True)
    assert text.tolist() == [0, 2, 3] and first.tolist() == [0, 3, 5] and g[0] == g[2] != g[1]


def test_codecs_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (ch.unpack_sorted(ch.pack_sorted(keys)) == keys).all()
        v = rng.integers(0, 70_000, n)
        assert (ch.unpack(ch.pack(ch.small_ints(v))).astype(np.int64) == v).all()


def test_pieces_grow_in_proportion(spark, monkeypatch):
    """Four times the input: about four times the pieces that chunks and ranges exchange, once chunks grow."""
    pieces = lambda n: n / ch.chunk_size(n) * n * ch.CHUNK / (4 << 20) / ch.chunk_size(n)
    for n in (10**11, 10**13):
        assert 3.9 < pieces(4 * n) / pieces(n) < 4.1
    monkeypatch.setattr(ch, "CHUNK", 6_000)
    monkeypatch.setattr(ch, "PIECE", 400)
    rng, found = random.Random(4), []
    for n in (150, 600):
        docs = H.docs(spark, [(i, H.prose(rng, 600, 10**6)) for i in range(n)]).select("doc_id", "text").coalesce(1)
        size = ch.text_bytes(docs)
        found.append(ch.tally(ch.make_chunks(docs, size), word_counts(), ch.bucket_count(size, 6_000), strips=ch.strip_count(size)).count())
    assert found[0] > 1_000 and 3 < found[1] / found[0] < 5


def word_counts():
    def prepare(b):  # not known by name, so it travels to the tasks as a whole
        batch = TextBatch(b.column("text"))
        starts, ends = batch.words()
        keys, n = np.unique(batch.hashes(starts, ends), return_counts=True)
        return keys, n, keys

    return prepare


@pytest.mark.parametrize("strips", [1, 3])
@pytest.mark.parametrize("chunk_bytes", [3_000, 5 << 20])
def test_tally_equals_a_plain_count(spark, strips, chunk_bytes):
    rng = random.Random(3)
    rows = [(i, H.prose(rng, 200, 50)) for i in range(40)] + [(99, None)]
    if chunk_bytes > ch.BLOCK:  # a chunk of several blocks
        rows += [(100 + i, H.prose(rng, 60_000, 50)) for i in range(36)]
    chunks = ch.make_chunks(H.docs(spark, rows).select("doc_id", "text").repartition(3), 10**6, chunk_bytes=chunk_bytes)
    assert chunks.count() > 5 or chunk_bytes > 3_000

    def check(block):
        assert len(block.own) == len(block.total) == len(block.fresh)
        return pa.table({"k": block.own.view(np.int64), "n": block.total[:, 0], "first": block.total[:, 1] * block.fresh, "row": np.full(len(block.own), block.first_row)})

    totals = ch.tally(chunks, word_counts(), 5, answer=lambda sums, own, first: np.stack([sums[:, 0], first], axis=1), strips=strips)
    got = ch.with_totals(chunks, totals, word_counts(), check, "k long, n long, first long, row long", 2)
    assert chunk_bytes <= ch.BLOCK or got.filter("row > 0").count()
    flat = {}
    for _, t in rows:
        for w in (t or "").split():
            flat[w] = flat.get(w, 0) + 1
    by_key = got.groupBy("k").agg({"n": "max", "first": "sum"}).collect()
    assert sorted(r["max(n)"] for r in by_key) == sorted(flat.values())
    assert {r["sum(first)"] for r in by_key} == {1}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (205, 204), (204, 205)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200, 204: 204, 205: 204}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=25).map(lambda b: bytes(x % 3 for x in b)), max_size=5))
def test_matching_statistics_equal_brute_force(strings):
    index = RunIndex(strings)
    got = index.matching_statistics()
    places = [(i, j) for i, s in enumerate(strings) for j in range(len(s))]

    def agree(a, b):
        x, y, n = strings[a[0]][a[1]:], strings[b[0]][b[1]:], 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for p in places:
        assert got[index.starts[p[0]] + p[1]] == max((agree(p, q) for q in places if q != p), default=0)
    assert index.run_length.sum() == len(index.text)
