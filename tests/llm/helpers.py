"""Small frames with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, key string, n_words int, kept string, slot int, score double, shard int"
LABELS = "doc_id long, quality int, toxic int"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=SPACE_WORD):
    return pattern.findall((text or "").translate(LOW))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    """(doc_id, text): nulls, empty, blank, short, very long, copies, near-copies, shared passages, repeated rows."""
    rng = random.Random(4)
    passage = prose(rng, 120)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "changed"
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one  TWO"), (5, base), (6, base), (7, " ".join(near)),
           (8, prose(rng, 30) + " " + passage + " " + prose(rng, 30)), (9, prose(rng, 20) + " " + passage), (10, prose(rng, 60_000)),
           (11, "aa " * 1500), (12, "éàü " * 300), (13, prose(rng, 90)), (13, prose(rng, 80)), (14, "same row"), (14, "same row"),
           (15, "!!! ... 123"), (None, prose(rng, 40)), (16, "\x00\x01 odd   bytes ퟿")]
    out += [(100 + i, prose(rng, rng.randrange(1, 160))) for i in range(60)]
    return out


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", "s", len(t or ""), 7, "k", 1, "x", 2, 0.5, 3) for i, t in rows], SCHEMA)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, window int")


def shingles(text, n=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i:i + n]) for i in range(len(w) - n + 1)))


def jaccard_groups(rows):
    """Smallest linked doc_id of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    group = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            group[find(i)] = min(group.get(find(i), d), d)
    return [(d, len(sets[i]), group.get(find(i), d)) for i, (d, _) in enumerate(rows)]


def repeats(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of the rest) by a table of all strings."""
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            k = hash(d[i:i + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    """Rows of the decontamination contract, by comparing every window everywhere."""
    wins = {}
    for item, text in items:
        w = words(text, BENCH_WORD)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w = words(text, BENCH_WORD)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def same_rows(df, expected):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(expected, key=key)
