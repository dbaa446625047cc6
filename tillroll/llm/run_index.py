"""Run-length index of a set of byte strings (run-compressed Burrows-Wheeler transform).

Suffixes of the concatenation, each string with an end mark of its own, are
sorted by prefix doubling. The transform is kept as runs; at each run's two ends
the index samples the text position and how far that suffix agrees with its
neighbour across the run boundary. Inside a run both neighbours are one step of
their own left extension, so all other agreements follow by walking the text:
one position further, one byte less. ``matching_statistics`` streams that walk
and gives, for every byte position, the longest match that also starts elsewhere.
"""

from __future__ import annotations

import numpy as np

_WIDTH = 7  # symbols of 9 bits in one 63-bit key


class RunIndex:
    """Index of byte strings.

    ``text``: symbols (byte + 1, end mark 0); ``starts``: first position of each
    string; ``run_symbol``/``run_length``: the transform; ``head``/``tail``: text
    positions at the runs' ends; ``head_match``/``tail_match``: agreement with the
    suffix before the run and after it.
    """

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        self.starts = np.cumsum(size) - size
        raw = np.frombuffer(b"\0".join(strings) + b"\0" if strings else b"", dtype=np.uint8)
        self.text = raw.astype(np.uint16) + 1
        self.text[self.starts + size - 1] = 0
        n = len(raw)
        if not n:
            self.run_symbol = self.run_length = self.head = self.tail = self.head_match = self.tail_match = np.zeros(0, np.int64)
            return
        longest = int(size.max())
        levels, order = self._ranks(longest)
        before = self.text[order - 1]  # the symbol to the left; position 0 wraps to the last end mark
        new = np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0))  # end marks differ from each other
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:] - 1, n - 1)
        self.run_symbol, self.run_length = before[heads], np.diff(np.append(heads, n))
        self.head, self.tail = order[heads], order[tails]
        self.head_match, self.tail_match = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        across = self._agree(levels, order[heads[1:] - 1], order[heads[1:]])
        self.head_match[1:], self.tail_match[:-1] = across, across

    def _ranks(self, longest: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Ranks by the first 7, 14, ... symbols, and the suffix array."""
        n = len(self.text)
        key = np.zeros(n, dtype=np.int64)
        stopped = np.zeros(n, dtype=bool)
        padded = np.append(self.text, np.zeros(_WIDTH, np.uint16))
        for j in range(_WIDTH):  # symbols behind an end mark do not count
            here = padded[j:j + n]
            key = (key << 9) | np.where(stopped, 0, here).astype(np.int64)
            stopped |= here == 0
        order = np.argsort(key)
        tied = np.flatnonzero(stopped[order])  # equal keys that reach an end mark: by position
        own = order[tied]
        order[tied] = own[np.lexsort((own, key[own]))]
        k, s = key[order], stopped[order]
        ranks = np.cumsum(np.append(False, (k[1:] != k[:-1]) | s[1:] | s[:-1]))
        rank = np.empty(n, dtype=np.int32)
        rank[order] = ranks
        levels, width, bits = [(_WIDTH, rank)], _WIDTH, int(n).bit_length()
        while width < longest and ranks[-1] < n - 1:
            # sort (rank, rank of what follows, position): in one word where it fits
            second = np.zeros(n, dtype=np.int64)
            second[:n - width] = rank[width:]
            second[:n - width] += 1
            if 3 * bits <= 63:
                word = np.sort((((rank.astype(np.int64) << bits) | second) << bits) | np.arange(n))
                order, pair = word & ((1 << bits) - 1), word >> bits
            else:
                pair = rank.astype(np.int64) * (n + 1) + second
                order = np.argsort(pair)
                pair = pair[order]
            ranks = np.cumsum(np.append(False, pair[1:] != pair[:-1]))
            rank = np.empty(n, dtype=np.int32)
            rank[order] = ranks
            width *= 2
            levels.append((width, rank))
        return levels, order

    def _agree(self, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            x, y = a + out, b + out
            fits = (x < n) & (y < n)
            out += np.where(fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]), width, 0)
        for _ in range(_WIDTH - 1):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (self.text[x] == self.text[y]) & (self.text[x] != 0)
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match that starts at another position too."""
        n = len(self.text)
        return np.maximum(self._walk(self.head, self.head_match, n), self._walk(self.tail, self.tail_match, n))

    @staticmethod
    def _walk(sample: np.ndarray, match: np.ndarray, n: int) -> np.ndarray:
        """Matches at sampled positions, carried on: one position further, one byte less."""
        at = np.full(n, -1, dtype=np.int64)
        at[sample] = sample
        length = np.zeros(n, dtype=np.int64)
        length[sample] = match
        at = np.maximum.accumulate(at)
        return np.where(at >= 0, np.maximum(length[at] - (np.arange(n) - at), 0), 0)
