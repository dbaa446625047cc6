"""Vectorised tokenising and hashing of text batches (numpy inside Spark tasks).

A ``TextBatch`` holds whole texts as one byte array; words and n-grams are found
and hashed for all texts of the batch at once. Hashes are 64-bit, equal on every
machine, and depend only on the bytes: a polynomial of them modulo 2**64. That alone
gives some regular strings of a thousand bytes the same value whatever its base, so
long strings are told apart by a second one, modulo the prime 2**31 - 1.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_NGRAM = U64(0xD6E8FEB86659FD93)
_PRIME = (1 << 31) - 1
_PRIME_BASE = 0x3C6EF35F
_LONG = 128  # bytes of a string beyond which the second polynomial counts
_PRIME_INV = pow(_PRIME_BASE, -1, _PRIME)

#: ASCII white space, upper-case letters, and the bytes that are in no benchmark word.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded) -> np.ndarray:
    """Table of 256 booleans: False for the excluded bytes."""
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


NOT_SPACE = byte_class(SPACE_BYTES)
#: word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_powers = {"n": 0, "pow": None, "inv": None}
_prime_powers = {"n": 0, "pow": None, "inv": None}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = -(-n // (1 << 18)) << 18
        for key, base in (("pow", _BASE), ("inv", _BASE_INV)):
            t = np.empty(size, dtype=U64)
            t[0] = 1
            done, step = 1, base
            while done < size:  # doubling: t[done:2*done] = t[:done] * base**done
                t[done:2 * done] = t[:min(done, size - done)] * U64(step)
                step = step * step % (1 << 64)
                done *= 2
            _powers[key] = t
        _powers["n"] = size
    return _powers["pow"], _powers["inv"]


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo the prime, and of its inverse."""
    if _prime_powers["n"] < n:
        size = -(-n // (1 << 18)) << 18
        for key, base in (("pow", _PRIME_BASE), ("inv", _PRIME_INV)):
            t = np.empty(size, dtype=np.uint32)
            t[0] = 1
            done, step = 1, base
            while done < size:
                t[done:2 * done] = t[:min(done, size - done)] * U64(step) % U64(_PRIME)
                step = step * step % _PRIME
                done *= 2
            _prime_powers[key] = t
        _prime_powers["n"] = size
    return _prime_powers["pow"], _prime_powers["inv"]


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, by adding the digits to the base 2**31 (in place)."""
    for _ in range(3):
        high = x >> U64(31)
        x &= U64(_PRIME)
        x += high
    x[x == U64(_PRIME)] = 0
    return x


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class TextBatch:
    """Whole texts, one after another, each followed by one line feed.

    ``buf``: bytes; ``starts``/``ends``: byte range of each text in ``buf``.
    """

    def __init__(self, texts: pa.Array | list, lower: bool = False):
        arr = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
        arr = pc.binary_join_element_wise(arr, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        n = len(arr)
        offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1] if n else np.zeros(1, np.int64)
        data = arr.buffers()[2] if n else None
        raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
        self.buf = LOWER[raw] if lower else raw
        offs = offs - offs[0]
        self.starts, self.ends = offs[:-1], offs[1:] - 1
        self.n = n
        self._sums = self._prime_sums = None

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position."""
        return np.searchsorted(self.starts, positions, side="right") - 1

    def words(self, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte positions of the maximal runs of word bytes."""
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        inside[1:-1] = table[self.buf]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal for equal bytes."""
        power, inverse = _power_tables(len(self.buf) + 1)
        if self._sums is None:
            self._sums = self._running_sums(power)
        size = ends - starts
        h = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        h = mix(h ^ (mix(size.astype(U64)) * U64(3)))
        long = np.flatnonzero(size > _LONG)
        if len(long):
            power, inverse = _prime_tables(len(self.buf) + 1)
            if self._prime_sums is None:
                self._prime_sums = self._running_sums(power, prime=True)
            other = _modulo(_modulo(self._prime_sums[ends[long]] - self._prime_sums[starts[long]]) * inverse[starts[long]])
            h[long] = mix(h[long] ^ mix(other + U64(1)))
        return h

    def _running_sums(self, power: np.ndarray, prime: bool = False) -> np.ndarray:
        """Sums of byte times power up to each position, in blocks that stay in the processor's cache;
        for the prime each term is below 2**32, so sums of 2**32 of them fit."""
        n = len(self.buf)
        sums = np.zeros(n + 1, dtype=U64)
        for a in range(0, n, 1 << 15):
            z = min(n, a + (1 << 15))
            term = self.buf[a:z].astype(U64)
            term += U64(1)
            term *= power[a:z]
            if prime:
                high = term >> U64(31)
                term &= U64(_PRIME)
                term += high
            term[:1] += sums[a:a + 1]
            np.cumsum(term, out=sums[a + 1:z + 1])
        return sums

    def counts_per_text(self, starts: np.ndarray) -> np.ndarray:
        """How many of the (ascending) positions lie in each text."""
        return np.diff(np.searchsorted(starts, np.append(self.starts, len(self.buf) + 1)))


def ngrams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each run of n hashes (len - n + 1 of them)."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.zeros(m, U64)
    for j in range(n):
        h = h * _NGRAM + word_hashes[j:j + m]
    return mix(h ^ U64(n))


def ngrams_by_text(word_hashes: np.ndarray, counts: np.ndarray, n: int, whole_if_short: bool = False):
    """N-grams that stay inside a text: (hash, text index, index of the first word in the batch).

    ``counts``: words of each text, in order. ``whole_if_short``: a text with
    1 to n-1 words gives its whole word sequence as one gram.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    per = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), per)
    first = np.repeat(starts, per) + _ramp(per)
    grams = ngrams(word_hashes, n)[first] if len(first) else np.zeros(0, U64)
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.array([ngrams(word_hashes[starts[i]:ends[i]], int(counts[i]))[0] for i in short], dtype=U64)
            grams, text, first = np.concatenate([grams, extra]), np.concatenate([text, short]), np.concatenate([first, starts[short]])
            order = np.argsort(text, kind="stable")
            grams, text, first = grams[order], text[order], first[order]
    return grams, text, first


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, concatenated."""
    total = int(lengths.sum())
    out = np.arange(total)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


ramp = _ramp


def give_back() -> None:
    """Return memory to the system at a task's end, tables of powers too: Python workers outlive their tasks."""
    for tables in (_powers, _prime_powers):
        tables.update(n=0, pow=None, inv=None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, text_col: str = "text", max_bytes: int = 1 << 19, last: bool = True):
    """Cut an iterator of record batches so that each holds about max_bytes of text (one row at least).

    ``last``: the task has nothing else to do with texts afterwards.
    """
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text_col))), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, z in zip(np.append(0, cuts), np.append(cuts, n)):
            yield b.slice(int(a), int(z - a))
    if last:
        give_back()
