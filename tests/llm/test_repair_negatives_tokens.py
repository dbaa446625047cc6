"""Hard negatives, conversation repair and token counts against brute force, on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm import conversation_repair, hard_negatives, queries, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


# 11 hard negatives

def vectors(rng, n=400, d=6, groups=12):
    """(vec_id, embedding, label): a cell with a third of the rows, copies, ties, and rows that take no part."""
    middle = rng.normal(size=(groups, d))
    rows = [(i, (middle[0] if i % 3 == 0 else middle[rng.integers(groups)] + 0.3 * rng.normal(size=d)).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (n + 2, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (n + 3, [math.nan] * d, 1), (n + 4, [math.inf] * d, 2), (None, rows[0][1], 1),
             (n + 5, [1.0, 2.0], 1), (n + 6, [], 1), (n + 7, [0.0] * d, 3), (5, rows[5][1], rows[5][2]), (n + 100 - n % 100, rows[1][1], 2)]
    return rows


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, k, 1, 0.5, 7) for i, v, k in rows], f"vec_id long, embedding array<{kind}>, label int, shard int, score double, rank int")


def hard(rows, d, every=100, positives=5, negatives=10, scale=256):
    fine = {(i, k, tuple(math.floor(scale * x) for x in v)) for i, v, k in rows
            if i is not None and v is not None and len(v) == d and k is not None and all(x is not None and math.isfinite(x) for x in v)}
    fine = [(i, (k + 1) % 10 if i % 7 == 0 else k, q) for i, k, q in fine]
    out = []
    for i, k, q in fine:
        if i % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(q, r)), j, m) for j, m, r in fine if (j, m, r) != (i, k, q))
        for s, j, m in [t for t in score if t[2] == k][:positives]:
            found = [t for t in score if t[2] != k and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(i, j, n + 1, t[1], -s, -t[0]) for n, t in enumerate(found)]
    return sorted(out)


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("shard_rows,home_rows", [(8192, 16384), (40, 60)])
def test_hard_negatives_are_exact(spark, shard_rows, home_rows):
    rows = vectors(np.random.default_rng(3))
    got = hard_negatives.mine(frame(spark, rows), "vec_id % 20 = 0", moved(), centroids=5, shard_rows=shard_rows, home_rows=home_rows, block_anchors=7)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == hard(rows, 6, 20)


def test_hard_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (i % 5 * 2)).tolist(), i % 3) for i in range(90)]
    got = hard_negatives.mine(frame(spark, rows), "vec_id % 10 = 0", centroids=3, shard_rows=20, home_rows=20)
    plain = sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    fine = [(i, k, tuple(math.floor(256 * x) for x in v)) for i, v, k in rows]
    out = []
    for i, k, q in fine:
        if i % 10 == 0:
            score = sorted((-sum(x * y for x, y in zip(q, r)), j, m) for j, m, r in fine if j != i)
            for s, j, _ in [t for t in score if t[2] == k][:5]:
                out += [(i, j, n + 1, t[1], -s, -t[0]) for n, t in enumerate([t for t in score if t[2] != k and 30 * -s <= 100 * -t[0] <= 90 * -s][:10])]
    assert plain == sorted(out)


def test_hard_negative_windows_stop_early():
    """Well apart cells: the heap stops before most rows are scored, and products stay exact beyond doubles."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (5_000, 4)) + c for c in ([1000, 0, 0, 0], [0, 1000, 0, 0], [0, 0, 1000, 0], [0, 0, 0, 1000])]).astype(np.int64)
    books = hard_negatives.Halves(x, 4, 1)
    cell, far = books.cells(x)
    import pyarrow as pa

    t = pa.table({"shard": pa.array([0] * len(x), pa.int32()), "cell": cell.astype(np.int32), "far1": far[0], "far2": far[1], "vec_id": np.arange(len(x)),
                  "label": np.arange(len(x)) % 2, "q": pa.array(x.tolist(), pa.list_(pa.int64()))})
    shard = hard_negatives.Shard(hard_negatives.Shard.pack(t, books).to_pylist()[0], books)
    scored = []
    plain = shard.score
    shard.score = lambda rows, a, fast: scored.append(len(rows)) or plain(rows, a, fast)
    w = hard_negatives.Windows(np.array([0]), np.array([hard_negatives.LEAST]), np.array([hard_negatives.MOST]), np.array([hard_negatives.LEAST]), 10)
    a = np.array([7, 0, 0, 0])
    shard.visit(-1, 0, a, [h[0] for h in books.bounds(a[None], shard.radii)], True, w)
    assert sorted(w.scores[0].tolist()) == sorted((x[::2] @ a).tolist())[-10:] and sum(scored) < len(x) / 3
    big = np.array([[1 << 50, 3], [-(1 << 50), 1], [5, 1 << 61]])
    assert hard_negatives.products(big, np.array([1 << 40, 7])).tolist() == [min(max(int(r[0]) * (1 << 40) + int(r[1]) * 7, -(1 << 63)), (1 << 63) - 1) for r in big]


def test_hard_negatives_of_nothing(spark):
    schema = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], [(None, None, None)], [(3, [1.0, 2.0], 1)], [(100, [1.0, 2.0], 1)], [(100, [0.0], 1), (101, [0.0], 1)]):
        got = hard_negatives.mine(frame(spark, rows), "vec_id % 100 = 0")
        assert got.columns == schema and not got.collect()


# 12 conversation repair

def broken(rows):
    """Rows after damage, by conversation, in order; rows with all values."""
    kept = {}
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = kept.setdefault(conv, [])
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        if draw:
            own += [(turn, role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in kept.items()}


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired turns) by memoised search over tuples, any number of insertions that cost no more than deleting all."""
    most = 2 * len(rows) // 5 + 1

    @lru_cache(None)
    def best(i, g, inserted):
        options = []
        if i == len(rows) and (g in ("", "a")):
            options.append((0, "", ()))
        nxt = "a" if g == "u" else "u"
        if inserted < most:
            c, s, t = best(i, nxt, inserted + 1)
            options.append((c + 5, "I" + s, ((("user", "assistant")[nxt == "a"], ""),) + t))
        if i < len(rows):
            _, role, text = rows[i]
            c, s, t = best(i + 1, g, inserted)
            options.append((c + 2, "D" + s, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                if role[:1] == nxt or role[:1] == "s" and g == "":
                    c, s, t = best(i + 1, role[:1], inserted)
                    options.append((c + extra, "K" + s, ((role, text),) + t))
                for name in ("user", "assistant"):
                    if name[0] == nxt:
                        c, s, t = best(i + 1, nxt, inserted)
                        options.append((c + 1 + extra, "R" + s, ((name, text),) + t))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def exhaustive(rows, faults):
    """The same by trying every string of edits with up to two insertions in a gap."""
    found = []
    for edits in itertools.product("KRrD", repeat=len(rows)):
        for holes in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
                continue
            cost, audit, turns = 0, "", []
            for i, hole in enumerate(holes):
                for c in hole:
                    cost, audit = cost + 5, audit + "I"
                    turns.append(({"u": "user", "a": "assistant"}[c], ""))
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    cost += {"K": 0, "D": 2}.get(e, 1) + 5 * (e != "D" and faults[i] == "truncated")
                    audit += e.upper()
                    if e != "D":
                        turns.append((role if e == "K" else "user" if e == "R" else "assistant", text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found.append((cost, audit, tuple(turns)))
    return min(found)


def expected(rows):
    out = []
    for conv, own in broken(rows).items():
        faults, turns = fault_of(own), [r[0] for r in own if r[0] is not None]
        cost, audit, kept = cheapest(tuple(own), tuple(faults))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def conversations(seed=2, n=260):
    rng = random.Random(seed)
    said = ["Yes.", "No?", "and so", "", " \n", "Oh! ", "Well... \t", "é.", "fin", "Long " * 400 + ".", None, "x.y", ".", "\xa0", "a.\nb"]
    rows = []
    for c in range(n):
        plain = c % 3 == 0
        for t in range(rng.randrange(1, 9)):
            role = ("user", "assistant")[t % 2] if plain else rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "sys", "ü"])
            rows.append((c, None if rng.random() < 0.03 else t + (rng.random() < 0.1) * 3, role, f"Turn {t} of {c}." if plain and rng.random() < 0.7 else rng.choice(said)))
    rows += rows[:30] + [(None, t, r, f"none {t}.") for t, r in enumerate(["system", "user", "assistant", "user"])] + [(9000 + c, 0, "user", "only.") for c in range(40)]
    rows += [(8000, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", f"{rng.randrange(40)} said{rng.choice('.!? ')}") for t in range(300)]
    rows += [(8001, 1 << 62, "user", "far."), (8001, -(1 << 62), "assistant", "near.")]
    rng.shuffle(rows)
    return rows


CONV = "conv_id long, turn long, role string, text string"


def test_conversation_repair_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV)
    for c in ("draw", "lost", "fault", "nth", "copy", "audit", "n"):
        df = df.withColumn(c, F.lit("clash"))
    got = conversation_repair.repair_conversations(df.repartition(5), conversation_repair.contract_draw())
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_big_integers_order_as_exhaustive_search():
    rng = random.Random(6)
    for n in (0, 1, 2, 3):
        for _ in range((1, 10, 40, 12)[n]):
            rows = [(i, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b.", "c", ""])) for i in range(n)]
            faults = fault_of(rows)
            want = exhaustive(rows, faults)
            assert cheapest(tuple(rows), tuple(faults)) == want
            repair = conversation_repair.Repair()
            for (_, role, text), f in zip(rows, faults):
                repair.add(role, text.encode(), ("", "blank", "duplicate", "truncated").index(f))
            sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want[2]).encode()).hexdigest()
            assert repair.finish() == (want[0], want[1], sha)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_do_not_change_the_repair(block, monkeypatch):
    """Only ranks cross from block to block: same result with any block length."""
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair.Repair, "HISTORY", conversation_repair.FIELD * (block + 1))
    monkeypatch.setattr(conversation_repair.Repair, "TOP", conversation_repair.FIELD * (block + 1) + conversation_repair.BITS)
    rng = random.Random(block)
    for n in (1, 5, 6, 7, 14, 130):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", "", f"{i}.", f"{i}"])) for i in range(n)]
        faults = fault_of(rows)
        repair = conversation_repair.Repair()
        for (_, role, text), f in zip(rows, faults):
            repair.add(role, text.encode(), ("", "blank", "duplicate", "truncated").index(f))
        cost, audit, kept = cheapest(tuple(rows), tuple(faults))
        assert repair.finish() == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def test_a_long_conversation_takes_linear_time():
    repair = conversation_repair.Repair()
    for i in range(40_000):
        repair.add(("user", "assistant", "system")[i % 3], b"x.", 0)
    cost, audit, _ = repair.finish()
    assert len(audit) >= 40_000 and cost > 0
    assert max(p.weight.bit_length() for p in repair.paths.values()) < 1_000


def test_conversation_repair_of_nothing(spark):
    got = conversation_repair.repair_conversations(spark.createDataFrame([], CONV), conversation_repair.contract_draw())
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and not got.collect()
    undamaged = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Oh.")], CONV)
    assert conversation_repair.repair_conversations(undamaged).first().audit == "KK"


def test_conversation_query_reads_all_rows(spark):
    got = queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got), key=str) == expected(rows)


# 13 token counts

def awkward_texts():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "s", "1", "é", "½", "٣", "​", "　", "中", "!", "😀", "՘", "\x1c", "\x85", "\x0b", "₏"]
    out = [None, "", " ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "  lead", "trail  ", "\n\n a \t\tb", "it's we'll 'S I'M x'd", "ab" * 30_000, "word " * 40_000, "\x00 odd"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]


def tokens(texts):
    t = Tokenizer.from_file(BYTES)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("frequent", [{}, {" the": 1, "a": 1}])
def test_pre_token_lengths_add_up(frequent, monkeypatch):
    texts = [t or "" for t in awkward_texts()]
    words = token_counts.PreTokens(BYTES, frequent, max_cached=50)
    assert words.counts(texts).tolist() == tokens(texts)
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 7)
    assert words.counts(texts).tolist() == tokens(texts)
    assert {"՘", "₏"} >= words.unlike


def test_token_counts_of_awkward_rows(spark):
    texts = awkward_texts()
    rows = [(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n_tokens", F.lit(1)).repartition(4)
    got = token_counts.count_tokens(df, BYTES, limit=20, max_docs=50, max_entries=40)
    want = [(d, len((t or "").encode()), n, n > 20) for (d, t), n in zip(rows, tokens(texts) * 2)]
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert not token_counts.count_tokens(df.limit(0), BYTES).collect()


def test_frequent_table_is_bounded(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}x{i}" for j in range(50)) + " the the") for i in range(100)], "doc_id long, text string")
    top = token_counts.frequent_lengths(df, BYTES, 100, 30, 32, "text")
    assert len(top) <= 30 and " the" in top.column("piece").to_pylist()
    assert top.column("tokens").to_pylist() == tokens(top.column("piece").to_pylist())


def test_token_query_equals_the_tokenizer(spark):
    got = {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], tokens([r.text for r in rows])))
