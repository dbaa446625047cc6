"""Repair of conversation structure by scalar big-integer weights.

A conversation's rows are kept, given another role, deleted, or joined by inserted
turns so that the roles read (s?(ua)+)?: nothing, or a system turn if any and then
user and assistant in turn. A shortest path through a DAG decides which: its nodes
are (rows done, what the roles so far allow), its edges one row's edit with an
insertion before it or not. The weight of an edge is one whole number: the cost in
the high digits, and below it the letters of the audit, in a field of two digits
that belongs to this row alone. Fields are left-aligned with zeros at their end, so
comparing two sums compares costs first and then the audits as texts: a row's letters
end in its only non-insertion, hence no row's letters begin another's, and at the
end of the conversation the zero makes the shorter audit the smaller. The ordinary
minimum of whole numbers is all the programme does.

One insertion between two rows is enough: two in a row lead back to what the roles
allowed before or to less (from nothing or a lone system turn), for 10.

Rows stream through one task for each conversation, in order, with bounded memory:
every BLOCK rows the paths (at most four) write down their letters, and only their
rank among each other goes on as a digit, so the numbers stay short and time is
linear. The hash of the repaired conversation is carried along each path, so texts
are never kept. Whether a row repeats an earlier one is found before by a window
over (conversation, role, text), which spreads a long conversation. What grows with
one conversation is its audit: a letter for each row, which is the result.

Edge cases. Null roles and texts are one space; a null conv_id or turn is one space
where the damage is drawn, comes first in order, and rows without conv_id form one
conversation. Rows with the same turn are ordered by role and text (bytes). Only
roles that begin with s, u or a can be kept; an empty role has no initial, so its
pairs are illegal. Repeated rows are duplicates like any other. Very long texts pass
through as they are. No rows: no result. Gaps beyond the range of longs: the largest
long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.words import give_back

#: Costs of the edits, digits of their letters (in ASCII order), white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = " DIKR"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

D, I, K, R = (LETTERS.index(c) for c in "DIKR")
BITS = 3  # of a digit
FIELD = 2 * BITS  # of a row
BLOCK = 64  # rows between two rankings
#: what the roles so far are: nothing, a system turn, ... user, ... assistant; the next turn each allows, and where that leads
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ("u", "u", "a", "u")
LEADS = {"u": AFTER_U, "a": AFTER_A}
NAMES = {"u": b"user:", "a": b"assistant:"}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame, draw: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, lost, role, text) of damaged rows; ``draw``: 0 loses the row (it stays as a mark of its
    conversation, without role and text), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user."""
    lost, space = F.col("draw") == 0, F.lit(" ")
    text = F.when(lost, None).when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(lost, None).when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    rows = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), space).alias("text"), draw.alias("draw"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", lost.alias("lost"), role.alias("role"), text.alias("text"))


def contract_draw(conv_col: str = "conv_id", turn_col: str = "turn") -> Column:
    """crc32 of conv_id:turn, modulo 20 (nulls: one space)."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col))
    return F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows with the first fault of each (0 for lost rows)."""
    before = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    ends = F.right(bare, F.lit(1)).isin(*ENDS)
    fault = F.when(F.col("lost"), FINE).when(bare == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~ends, CUT).otherwise(FINE)
    return rows.withColumn("nth", F.when(F.col("lost"), 1).otherwise(F.row_number().over(before))).withColumn("fault", fault.cast("int")).drop("nth")


class Path:
    """A path to one node: its weight within the block, the blocks before, and the hash of what it keeps."""

    __slots__ = ("weight", "past", "sha", "empty")

    def __init__(self, weight: int, past: tuple | None, sha, empty: bool):
        self.weight, self.past, self.sha, self.empty = weight, past, sha, empty

    def then(self, weight: int, turns: list[tuple[bytes, bytes]]) -> Path:
        """This path with one more edit, which keeps or makes these turns (role and colon, text)."""
        sha, empty = self.sha, self.empty
        if turns:
            sha = sha.copy()
            for role, text in turns:
                sha.update(role if empty else b"\n" + role)
                sha.update(text)
                empty = False
        return Path(weight, self.past, sha, empty)


class Repair:
    """The cheapest edits of one conversation, its rows given one by one."""

    def __init__(self):
        self.paths: dict[int, Path] = {NOTHING: Path(0, None, hashlib.sha256(), True)}
        self.cost, self.rows = 0, 0  # cost: what all paths have in common, from finished blocks

    # A weight is cost * 2**TOP + rank of the path at the block's start * 2**HISTORY + the fields of the block's rows.
    HISTORY = FIELD * (BLOCK + 1)
    TOP = HISTORY + BITS

    def add(self, role: str, text: bytes, fault: int) -> None:
        at = self.rows % BLOCK
        if not at and self.rows:
            self._rank()
        low = self.HISTORY - FIELD * (at + 1)
        extra = TRUNCATED if fault == CUT else 0
        own = (role.encode() + b":", text)
        best: dict[int, tuple] = {}
        for state, path in self.paths.items():
            for inserted in (False, True):
                turns, g, digits, cost = [], state, 0, 0
                if inserted:
                    turns, g, digits, cost = [(NAMES[NEXT[g]], b"")], LEADS[NEXT[g]], I, INSERT
                for letter, to, kept, price in self._edits(g, role[:1], fault, extra, own):
                    code = (digits << BITS | letter) if inserted else letter << BITS
                    weight = path.weight + (cost + price << self.TOP) + (code << low)
                    if to not in best or weight < best[to][0]:
                        best[to] = (weight, path, turns + kept)
        self.paths = {to: path.then(weight, turns) for to, (weight, path, turns) in best.items()}
        self.rows += 1

    @staticmethod
    def _edits(g: int, initial: str, fault: int, extra: int, own: tuple) -> Iterator[tuple]:
        """(letter, state after, turns that stay, cost) of what can be done with a row."""
        yield D, g, [], DELETE
        if fault in (BLANK, DUPLICATE):
            return
        wanted = NEXT[g]
        if initial == wanted:
            yield K, LEADS[wanted], [own], KEEP + extra
        elif initial == "s" and g == NOTHING:
            yield K, AFTER_S, [own], KEEP + extra
        yield R, LEADS[wanted], [(NAMES[wanted], own[1])], REROLE + extra

    def _letters(self, weight: int, fields: int, tail: bool = False) -> str:
        """The letters of a block's first rows (and of the field after them)."""
        out = []
        for k in range(fields + tail):
            field = weight >> self.HISTORY - FIELD * (k + 1)
            out += [field >> BITS & 7, field & 7]
        return "".join(LETTERS[d] for d in out if d)

    def _rank(self) -> None:
        """End a block: letters go to the path's past, the order of the paths goes on as a digit."""
        history = lambda p: p.weight & (1 << self.TOP) - 1
        order = {h: i for i, h in enumerate(sorted({history(p) for p in self.paths.values()}))}
        base = min(p.weight >> self.TOP for p in self.paths.values())
        for p in self.paths.values():
            p.past = (p.past, self._letters(p.weight, BLOCK))
            p.weight = ((p.weight >> self.TOP) - base << self.TOP) + (order[history(p)] << self.HISTORY)
        self.cost += base

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired conversation)."""
        at = self.rows - (self.rows - 1) // BLOCK * BLOCK if self.rows else 0
        low = self.HISTORY - FIELD * (at + 1)
        ends = [p for g in (NOTHING, AFTER_A) if (p := self.paths.get(g))]
        if (p := self.paths.get(AFTER_U)):
            ends.append(p.then(p.weight + (INSERT << self.TOP) + (I << BITS + low), [(NAMES["a"], b"")]))
        path = min(ends, key=lambda p: p.weight)
        letters, past = [self._letters(path.weight, at, tail=True)], path.past
        while past:
            letters.append(past[1])
            past = past[0]
        return self.cost + (path.weight >> self.TOP), "".join(reversed(letters)), path.sha.hexdigest()


class Conversation:
    """What is reported of one conversation, its rows given in order."""

    LEGAL = ("su", "ua", "au")

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.least = self.last_turn = self.before = None

    def add(self, turn: int | None, role: str, text: bytes, fault: int) -> None:
        if turn is not None:  # in ascending order
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.before is not None and self.before + role[:1] not in self.LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.faults[fault] += 1
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return (self.conv_id, min(gaps, (1 << 63) - 1), *self.faults[1:], self.illegal, *self.repair.finish())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result row for each conversation of the sorted rows."""
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    current, out = None, []

    def results(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names=names)

    for b in batches:
        for at in range(0, b.num_rows, 512):  # so many rows as Python objects at a time
            part = b.slice(at, 512)
            columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "lost", "role")]
            for conv_id, turn, lost, role, text, fault in zip(*columns, part.column("text").cast(pa.binary()).to_pylist(), part.column("fault").to_pylist()):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        out.append(current.row())
                    current = Conversation(conv_id)
                if not lost:
                    current.add(turn, role, text, fault)
        if len(out) >= 1_000:
            yield results(out)
            out = []
    if current is not None:
        out.append(current.row())
    yield results(out)
    give_back()


def repair_conversations(rows: DataFrame, draw: Column | None = None) -> DataFrame:
    """One row for each conv_id: counts of gaps and faults, cost and audit of the cheapest repair, hash of its result.

    ``draw``: the damage of each row (see ``damaged``); none by default.
    """
    faulty = with_faults(damaged(rows, F.lit(-1) if draw is None else draw))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault") == DUPLICATE]
    dealt = faulty.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_stream, RESULT)
