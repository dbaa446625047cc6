"""Exact Jaccard join of word-shingle sets by prefix filters under several global orders.

Two sets with Jaccard similarity of at least t share at least ceil(t * size) of
either's shingles, so under any order of all shingles their first
``size - ceil(t * size) + 1`` shingles have one in common. Linked documents
share prefix shingles under every order; the orders' filters are intersected
before a pair is verified.

1. An order that needs no counts, by hash, with prefixes longer by a quarter of
   the size: if every prefix takes m more shingles, the first m + 1 common ones lie
   in both prefixes (m of the smaller partner). Only documents with that many
   prefix shingles in other documents' prefixes stay active (``chunks.tally``
   counts them); a unique text ends here. Documents with equal sets are one class,
   and only its first document carries the set.
2. Class frequencies of all shingles of the active classes are counted. Two
   further orders begin with the rarest shingle, ties by different hashes; a class
   without a shared shingle in either prefix ends here.
3. Candidate pairs share a prefix shingle under the first rarity order, meet the
   size and positional bounds there, and must share one under the second; then the
   sets are compared.
   First each shingle's classes are compared with one or two pivot classes only, and
   verified links are merged into components. The last round compares every remaining
   pair of classes with a common prefix shingle that are still in different components.
   A group of m near-copies thus costs about m comparisons instead of m * m, and no
   link between different components is missed. A shingle that many classes share is
   dealt out in pieces, each with the pivots.

Edge cases. A text of 1 to 4 words is one shingle, its whole sequence. Null text
or no words: empty set, linked with nothing. Repeated rows and repeated doc_ids
are rows of their own; component_id is the smallest doc_id that links reach (null
if none of them has one). Very long texts have large sets like any others. Empty
tables give no rows; other columns are ignored, or kept by ``keep_one_per_group``,
whatever their names. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import chunks as ch
from tillroll.llm.common import cut
from tillroll.llm.components import components
from tillroll.llm.words import NOT_SPACE, TextBatch, mix, ngrams_by_text, ramp

SECOND = np.uint64(0xA24BAED4963EE407)
_ACTIVE = "doc_id long, chunk long, row int, n_shingles long, key binary, shingles binary"


class Similarity:
    """Jaccard threshold as a fraction, in exact integer arithmetic."""

    def __init__(self, percent: int = 75):
        self.percent = percent

    def prefix(self, size):
        """How many first shingles a set of this size must index."""
        return size - -(-self.percent * size // 100) + 1

    def spare(self, size):
        """How many more the longer prefix takes."""
        return size * (100 - self.percent) // 100

    def least_shared(self, size):
        """Shingles of the longer prefix that any partner has in its longer prefix: 1 + the smallest partner's spare."""
        return self.spare(-(-self.percent * size // 100)) + 1

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts (ascending within a text) and how many each has."""
    batch = TextBatch(texts, lower=True)
    starts, ends = batch.words(NOT_SPACE)
    grams, text, _ = ngrams_by_text(batch.hashes(starts, ends), batch.counts_per_text(starts), n, whole_if_short=True)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(text[new], minlength=batch.n).astype(np.int64)


def _set_keys(shingles: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    stop = np.cumsum(counts).tolist()
    return [hashlib.blake2b(shingles[z - n:z].tobytes(), digest_size=16).digest() if n else None for n, z in zip(counts.tolist(), stop)]


class _Prefixes:
    """Long prefixes of a chunk's texts under the hash order, and the keys of their whole sets."""

    def __init__(self, texts: pa.Array, sim: Similarity, n: int):
        self.shingles, self.counts = shingle_sets(texts, n)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.least = sim.least_shared(self.counts)
        take = np.minimum(sim.prefix(self.counts) + sim.spare(self.counts), self.counts)
        first = ramp(self.counts) < take[text]
        self.text = text[first]
        self.set_keys = _set_keys(self.shingles, self.counts)
        self.with_set = np.flatnonzero(self.counts > 0)
        whole = np.array([int.from_bytes(self.set_keys[i][:8], "little") for i in self.with_set.tolist()], dtype=np.uint64)
        # shingles have a lowest bit of 0, whole sets of 1
        self.keys, self.one, where = np.unique(np.concatenate([self.shingles[first] & ~np.uint64(1), whole | np.uint64(1)]), return_index=True, return_inverse=True)
        self.prefix_at, self.set_at = where[:len(self.text)], where[len(self.text):]
        self.found = np.bincount(where, minlength=len(self.keys))


def active_documents(chunks: DataFrame, n_bytes: int, sim: Similarity, n: int) -> DataFrame:
    """All documents with the size of their set; active ones have a key, and the first of each class carries the set."""

    def prepare(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, _Prefixes]:
        p = _Prefixes(rows.column("text"), sim, n)
        return p.keys, np.minimum(p.found, 2), p

    totals = ch.tally(chunks, prepare, ch.bucket_count(n_bytes, 6 << 20), strips=ch.strip_count(n_bytes), answer=lambda sums, own, first: np.concatenate([sums > 1, first[:, None]], axis=1).astype(np.int64))

    def mark(block: ch.Block) -> pa.Table:
        p, total, rows = block.own, block.total, block.rows
        shared = np.bincount(p.text[total[p.prefix_at, 0] > 0], minlength=len(p.counts))
        active = (p.counts > 0) & (shared >= p.least)
        carries = np.zeros(len(p.counts), bool)
        carries[p.with_set] = (total[p.set_at, 1] > 0) & block.fresh[p.set_at] & (p.one[p.set_at] == len(p.text) + np.arange(len(p.with_set)))
        stop = np.cumsum(p.counts).tolist()
        sets = [p.shingles[z - c:z].tobytes() if on else None for on, c, z in zip((active & carries).tolist(), p.counts.tolist(), stop)]
        place = np.arange(rows.num_rows, dtype=np.int32) + np.int32(block.first_row)
        return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "chunk": np.full(len(place), block.chunk), "row": place, "n_shingles": p.counts,
                         "key": pa.array([k if on else None for k, on in zip(p.set_keys, active.tolist())], pa.binary()), "shingles": pa.array(sets, pa.binary())})

    return cut(ch.with_totals(chunks, totals, prepare, mark, _ACTIVE, 2), ch.task_count(chunks, n_bytes))


def class_prefixes(classes: DataFrame, sim: Similarity) -> DataFrame:
    """Classes that share a prefix shingle under the rarity orders: (key, n, first, second, shingles).

    ``first``/``second``: the shared shingles of the prefix under two rarity
    orders, the first with their places in the whole ordered set.
    """
    n_bytes = ch.text_bytes(classes, "shingles")
    chunks = ch.make_chunks(classes.select("key", "shingles"), n_bytes, "shingles", write=False)

    def prepare(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every, counts = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]), return_counts=True)
        return every, counts, every

    totals = ch.tally(chunks, prepare, ch.bucket_count(n_bytes, 6 << 20), strips=ch.strip_count(n_bytes), size_col="shingles")

    def choose(block: ch.Block) -> pa.Table:
        rows, every, total = block.rows, block.own, block.total
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        out = []
        for key, own, raw in zip(rows.column("key").to_pylist(), sets, rows.column("shingles").to_pylist()):
            df = total[np.searchsorted(every, own), 0]
            take = int(sim.prefix(len(own)))
            parts = []
            for tie in (own, mix(own ^ SECOND)):
                p = np.lexsort((tie, df))[:take]
                at = np.flatnonzero(df[p] > 1)
                parts.append((own[p[at]], at, df[p[at]]))
            if all(len(p) for p, _, _ in parts):
                (first, at, found), (second, _, _) = parts
                out.append((key, len(own), [{"shingle": x, "at": i, "df": f} for x, i, f in zip(first.view(np.int64).tolist(), at.tolist(), found.tolist())], np.sort(second).tobytes(), raw))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({"key": pa.array(cols[0], pa.binary()), "n": pa.array(cols[1], pa.int64()), "first": pa.array(cols[2], pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("df", pa.int64())]))),
                         "second": pa.array(cols[3], pa.binary()), "shingles": pa.array(cols[4], pa.binary())})

    return cut(ch.with_totals(chunks, totals, prepare, choose, "key binary, n long, first array<struct<shingle: long, at: int, df: long>>, second binary, shingles binary", size_col="shingles"),
               ch.task_count(chunks, n_bytes))


def _verify(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) that share a prefix shingle under the second order too and whose sets are similar enough.

    Sets go to the pairs by ``b`` first: there are few pairs for each b, many for a pivot a.
    """
    a, b = (classes.select(F.col("key").alias(x), F.col("second").alias(f"p{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, row in enumerate(zip(*(batch.column(c) for c in ("pa", "pb", "sa", "sb")))):
                pre_a, pre_b, x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in row)
                if len(np.intersect1d(pre_a, pre_b, assume_unique=True)) and sim.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "pa", "pb", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _fit(sim: Similarity):
    """Size bound, and the positional bound: if the shingle is the first common one,
    no more can be common than what either set has from there on. A similar pair
    meets it at its first common shingle."""
    rest = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return ((F.lit(100 + sim.percent) * rest >= F.lit(sim.percent) * (F.col("na") + F.col("nb")))
            & (F.lit(100) * F.least("na", "nb") >= F.lit(sim.percent) * F.greatest("na", "nb")))


def _indexed(classes: DataFrame, parts: DataFrame | None, hot: int) -> DataFrame:
    """One row for each class and shared prefix shingle, with the class's component so far. A shingle that more
    than ``hot`` classes share is dealt out: its rows carry the piece that a hash of their class puts them in."""
    base = classes.select("key", "n", "first")
    # components join whole classes; shingles are exploded behind the join
    own = base.withColumn("part", F.col("key")) if parts is None else base.join(parts, "key")
    own = own.select("key", "n", "part", F.posexplode("first").alias("i", "x"))
    return own.select("key", "n", "part", "i", F.col("x.shingle").alias("shingle"), F.col("x.at").alias("at"), F.col("x.df").alias("df"),
                      F.pmod(F.xxhash64("key"), F.ceil(F.col("x.df") / hot)).cast("int").alias("piece"))


def _pivot_pairs(own: DataFrame, sim: Similarity, salts: int, hot: int) -> DataFrame:
    """Pairs of each class with the pivots of its shingles: first the class with the fewest rarer shingles, which in a
    group of near-copies has the fewest changes and is close to most of them; then, for each further salt, the one whose
    salted hash is smallest, the same for all shingles that the same classes share. At most ``salts`` pairs for each index row."""
    order = lambda s: F.min(F.struct(*([] if s else ["at"]), F.xxhash64("key", F.lit(s)).alias("h"), "key", "n", *(["at"] if s else []), "part")).alias(f"p{s}")
    same = lambda s: F.struct(*(F.col(f"p{s}.{c}").alias(c) for c in ("key", "n", "at", "part")))
    pivots = (own.groupBy("shingle").agg(*[order(s) for s in range(salts)], F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("df").alias("df"))
              .filter("lo <> hi").select("shingle", F.array(*[same(s) for s in range(salts)]).alias("pivots"),
                                         F.explode(F.sequence(F.lit(0), F.ceil(F.col("df") / hot).cast("int") - 1)).alias("piece")))
    met = own.select("shingle", "piece", "key", "n", "at", "part").join(pivots, ["shingle", "piece"]).select("*", F.explode(F.array_distinct("pivots")).alias("p"))
    return (met.filter("part <> p.part").select(F.col("p.key").alias("a"), F.col("key").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"),
                                                F.col("p.at").alias("ia"), F.col("at").alias("ib")).filter(_fit(sim)))


def _open_pairs(classes: DataFrame, own: DataFrame, sim: Similarity, tasks: int | None) -> DataFrame:
    """All pairs with a common prefix shingle whose classes are in different components."""
    # a shingle whose classes are all in one component has no open pair
    open_ = own.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("shingle")
    rest = own.join(open_, "shingle").join(classes.select("key", "first"), "key")
    rest = cut(rest.select("key", "n", "part", "shingle", "at", F.slice("first.shingle", F.lit(1), F.col("i")).alias("before")), tasks)
    x, y = (rest.select("shingle", F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("part").alias(f"part{c}"), F.col("at").alias(f"i{c}"),
                        F.col("before").alias(f"before{c}")) for c in "ab")
    # a pair comes out once, at its first common shingle
    return x.join(y, "shingle").filter("parta < partb").filter(_fit(sim)).filter(~F.arrays_overlap("beforea", "beforeb"))


def links(classes: DataFrame, sim: Similarity, rounds: int = 1, salts: int = 2, hot: int = 8_192, tasks: int | None = None) -> DataFrame:
    """(node, root) of the classes' components: ``rounds`` with pivots, then one with all open pairs.
    ``tasks``: the most files of each table that is written on the way; pairs and links are narrow and take fewer."""
    found, parts = None, None
    tasks = tasks and max(1, tasks // 16)
    for r in range(rounds + 1):
        own = _indexed(classes, parts, hot)
        pairs = _pivot_pairs(own, sim, salts, hot) if r < rounds else _open_pairs(classes, own, sim, tasks)
        checked = cut(_verify(pairs.select("a", "b").distinct(), classes, sim), tasks)
        found = checked if found is None else found.unionByName(checked)
        roots = components(found)
        parts = (classes.select("key").join(roots, F.col("key") == F.col("node"), "left")
                 .select("key", F.coalesce("root", "key").alias("part")))
    return roots


def _members(active: DataFrame, sim: Similarity, rounds: int, first, tasks: int) -> DataFrame:
    """(key, found): for every class the smallest ``first`` (an aggregate over rows) of its component."""
    classes = active.filter("key is not null").groupBy("key").agg(first.alias("first"))
    roots = links(class_prefixes(active.filter("shingles is not null"), sim), sim, rounds, tasks=tasks)
    # both sides of the last join are written: AQE splits a component that a third of all classes are in
    member = cut(classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root")), max(1, tasks // 16))
    smallest = cut(member.groupBy("root").agg(F.min("first").alias("found")), max(1, tasks // 16))
    return member.select("key", "root").join(smallest, "root").select("key", "found")


def jaccard_components(docs: DataFrame, percent: int = 75, n: int = 5, rounds: int = 1) -> DataFrame:
    """One row per document: size of its shingle set and the smallest doc_id that similarity links reach."""
    sim = Similarity(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    n_bytes = ch.text_bytes(rows)
    tasks = ch.task_count(rows, n_bytes)
    active = active_documents(ch.make_chunks(rows, n_bytes), n_bytes, sim, n)
    of_key = _members(active, sim, rounds, F.min("doc_id"), tasks)
    return (active.select("doc_id", "n_shingles", "key").join(of_key, "key", "left")
            .select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id")).coalesce(tasks))


def keep_one_per_group(docs: DataFrame, percent: int = 75, n: int = 5, rounds: int = 1) -> DataFrame:
    """The documents, all columns, one of each group of linked rows: the one with the smallest doc_id (null last).

    Rows are told apart by their place in the written chunks, not by doc_id: rows that share an id, or have none, are
    compared like any others, and of equal rows one stays. Rows without words are linked with nothing and stay.
    Links are found and rows chosen on ids and keys alone; the rows themselves stay in their chunks until then.
    """
    sim = Similarity(percent)
    n_bytes = ch.text_bytes(docs)
    tasks = ch.task_count(docs, n_bytes)
    chunks = ch.make_chunks(docs, n_bytes)
    active = active_documents(chunks.select("chunk", "payload"), n_bytes, sim, n)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "chunk", "row")
    of_key = _members(active, sim, rounds, F.min(place), tasks)
    dropped = (active.filter("key is not null").select("key", place.alias("own")).join(of_key, "key").filter("own <> found")
               .groupBy("own.chunk").agg(F.collect_list("own.row").alias("rows")))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, rows in zip(b.column("payload"), b.column("rows").to_pylist()):
                kept = ch.unpack_rows(payload.as_buffer())
                if rows:
                    stay = np.ones(kept.num_rows, bool)
                    stay[rows] = False
                    kept = kept.filter(pa.array(stay))
                yield kept

    return chunks.select("chunk", "payload").join(dropped, "chunk", "left").select("payload", "rows").coalesce(tasks).mapInArrow(rest, docs.schema)
