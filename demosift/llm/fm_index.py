"""A compressed FM-index over sequences of words, searched for many patterns at once.

The Burrows-Wheeler transform of the sequences is held in a wavelet matrix: one packed bit vector with
block counts for each bit of a symbol.  A backward step is two ranks.  Matching statistics up to a
threshold extend a match to the left; a match as long as the threshold first drops its last word by
widening its interval to the suffixes that share one word less.  Where the suffixes of an interval start
is found by walking left to the next sampled place.
"""

from __future__ import annotations

import numpy as np

#: Of so many places in the text one is kept.
SAMPLE = 4


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(n, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The bit at each position."""
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int8)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.shifts = range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        self.levels, left = [], symbols
        for shift in self.shifts:
            bits = (left >> shift & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            left = np.concatenate([left[bits == 0], left[bits == 1]])
        self.begins = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, shift in zip(self.levels, self.shifts, strict=True):
            ones = level.ones(at)
            at = np.where(symbols >> shift & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbols, at) - self.begins[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before that position."""
        symbols = np.zeros(len(at), np.int64)
        for level, shift in zip(self.levels, self.shifts, strict=True):
            bits, ones = level.get(at), level.ones(at)
            at = np.where(bits, level.zeros + ones, at - ones)
            symbols |= bits.astype(np.int64) << shift
        return symbols, at - self.begins[symbols]


class FMIndex:
    """Of sequences of words; ``window`` is the threshold of its matching statistics.

    What stays after the build: the wavelet matrix, the first row of each symbol, one byte for each suffix (how
    many words, up to the threshold, it shares with the one before) and the places of one suffix in
    ``SAMPLE``.  The suffix array and the ranks that sort it are dropped.
    """

    def __init__(self, sequences: list[list[bytes]], window: int):
        self.window = window
        flat = [w for s in sequences for w in s]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        words = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        count = len(sequences)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.total = total = int(sizes.sum()) + count
        ends = self.starts + sizes
        # each sequence's end sorts before all words and apart from other ends
        text = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[ends] = False
        text[inside] = words + count
        text[ends] = np.arange(count)
        suffixes = _sorted_suffixes(text, len(self.ids) + count)
        self.shared = _shared(text, suffixes, window)
        self.wavelet = WaveletMatrix(np.where(inside, text - count + 1, 0)[suffixes - 1], len(self.ids) + 1)
        self.first = np.concatenate([[0, count], count + np.cumsum(np.bincount(words, minlength=len(self.ids)))])[:-1] if self.ids else np.array([0])
        # a walk to the left must not leave its sequence, so every sequence's first suffix is a sample
        sampled = np.arange(total) % SAMPLE == 0
        sampled[self.starts] = True
        rows = sampled[suffixes]
        self.sampled, self.places = BitVector(rows.astype(np.uint8)), suffixes[rows].astype(np.int32)
        self._begins: dict[int, np.ndarray] = {}

    def begins(self, depth: int) -> np.ndarray:
        """The first of each run of suffixes that share ``depth`` words."""
        if depth not in self._begins:
            self._begins[depth] = np.flatnonzero(self.shared < depth).astype(np.int32)
        return self._begins[depth]

    def widened(self, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the suffixes that share ``depth`` words with a suffix."""
        if depth == 0:
            return np.zeros(len(rows), np.int64), np.full(len(rows), self.total)
        begins = self.begins(depth)
        at = np.searchsorted(begins, rows, side="right")
        return begins[at - 1].astype(np.int64), np.append(begins, self.total)[at].astype(np.int64)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text each suffix starts: left from it to a sampled one, counting steps."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            found = self.sampled.get(at) > 0
            out[todo[found]] = self.places[self.sampled.ones(at[found])] + steps
            todo, at = todo[~found], at[~found]
            symbols, before = self.wavelet.access(at)
            at = self.first[symbols] + before
            steps += 1
        return out

    def statistics(self, patterns: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all patterns, one after the other: for each word the length, up to the
        threshold, of the longest match that starts there, and its interval of suffixes."""
        sizes = np.array([len(p) for p in patterns], np.int64)
        known = self.ids.get
        flat = np.fromiter((known(w, -1) for p in patterns for w in p), np.int64, int(sizes.sum())) + 1
        stops = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        lo, hi, length = np.zeros(len(order), np.int64), np.full(len(order), self.total), np.zeros(len(order), np.int64)
        out = tuple(np.zeros(len(flat), np.int64) for _ in range(3))
        by_size = np.sort(sizes)
        for step in range(int(sizes.max(initial=0))):
            n = len(order) - int(np.searchsorted(by_size, step, side="right"))
            at = stops[order[:n]] - 1 - step
            self._extend(flat[at], lo[:n], hi[:n], length[:n])
            out[0][at], out[1][at], out[2][at] = length[:n], lo[:n], hi[:n]
        return out

    def _extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> None:
        """Adds a word to the left of each match, in place, shortening the match at its right as needed."""
        full = np.flatnonzero(length == self.window)
        if len(full):
            lo[full], hi[full] = self.widened(lo[full], self.window - 1)
            length[full] -= 1
        gone = c == 0
        lo[gone], hi[gone], length[gone] = 0, self.total, 0
        todo = np.flatnonzero(~gone)
        while len(todo):
            symbols, n = c[todo], len(todo)
            both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([lo[todo], hi[todo]]))
            a, b = self.first[symbols] + both[:n], self.first[symbols] + both[n:]
            good = a < b
            found = todo[good]
            lo[found], hi[found] = a[good], b[good]
            length[found] += 1
            # a known word always matches the empty string, so this ends
            todo = todo[~good]
            for depth in np.unique(length[todo]):
                part = todo[length[todo] == depth]
                length[part] = max(0, depth - 1)
                lo[part], hi[part] = self.widened(lo[part], int(max(0, depth - 1)))


def _sorted_suffixes(text: np.ndarray, values: int) -> np.ndarray:
    """Suffixes in order, by doubling the number of words that are compared."""
    total, rank, depth, order = len(text), text, 1, np.zeros(0, np.int64)
    while total:
        both = rank * (max(total, values) + 2)
        both[:-depth] += rank[depth:] + 1
        order = np.argsort(both)  # equal ones get one rank, so their order is free
        both = both[order]
        new = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
        if new[-1] == total - 1:
            break
        rank = np.empty(total, np.int64)
        rank[order] = new
        depth *= 2
    return order


def _shared(text: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """How many words each suffix shares with the one before it, up to ``most``; ends are shared by none."""
    out = np.zeros(len(suffixes), np.uint8 if most < 256 else np.int32)
    alive = np.arange(1, len(suffixes))
    for depth in range(most):
        alive = alive[text[suffixes[alive] + depth] == text[suffixes[alive - 1] + depth]]
        if not len(alive):
            break
        out[alive] = depth + 1
    return out


def intervals(lengths: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of words that matches of at least ``threshold`` words cover."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(lengths >= threshold).tolist():
        if out and i <= out[-1][1]:
            out[-1] = out[-1][0], i + int(lengths[i])
        else:
            out.append((i, i + int(lengths[i])))
    return out
