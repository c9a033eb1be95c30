"""Suffix arrays of many groups of byte strings at once, by induced sorting, and permuted common prefixes.

Groups are independent: suffixes are sorted within their group.  Sorting goes through all groups in step: buckets
are laid out by symbol and then by group, so that one step of the left-to-right or right-to-left scan takes a slice
of the array and handles the buckets of one symbol in every group.  Entries that a bucket induces into itself come
as further waves of the step, in the order of the scan.

Each suffix is larger (L) or smaller (S) than the next one; a leftmost smaller one (LMS) follows a larger one.  LMS
substrings are sorted by inducing from unsorted LMS places, named, and, where names repeat, the string of names is
sorted recursively; sorted LMS suffixes then induce all others.  Each step is linear in the places it touches.
"""

from __future__ import annotations

import numpy as np

#: Symbols of texts of bytes: the end of a group, the end of a string, then the bytes.
END, CUT, SHIFT = 0, 1, 2


class _Level:
    """A text of one or more groups, each ending in its only and smallest symbol zero."""

    def __init__(self, text: np.ndarray, group: np.ndarray):
        n = len(text)
        self.text, self.group, self.n = text, group, n
        self.first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        # a suffix is smaller than the next if its first different symbol is; the end of a group counts as smaller
        sign = np.sign(np.diff(text.astype(np.int64), append=0)).astype(np.int8)
        sign[text == END] = 1
        places = np.where(sign != 0, np.arange(n), n)
        ahead = np.minimum.accumulate(places[::-1])[::-1]
        self.small = sign[ahead] > 0
        self.lms = self.small & ~self.first
        self.lms[1:] &= ~self.small[:-1]
        # buckets by symbol, then group
        key = text.astype(np.int64) * (int(group[-1]) + 1 if n else 1) + group
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        self.begins = np.append(np.flatnonzero(new), n)
        self.bucket = np.empty(n, np.int32)
        self.bucket[order] = np.cumsum(new) - 1
        symbols = text[order]
        self.steps = np.append(np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])), n) if n else np.zeros(1, np.int64)
        self.symbols = symbols[self.steps[:-1]]

    def _put(self, sa: np.ndarray, places: np.ndarray, at: np.ndarray, way: int) -> None:
        """Appends places to their buckets' ends, in order; ``at`` holds the next free place of each bucket."""
        buckets = self.bucket[places]
        if len(places) == 1:
            sa[at[buckets[0]]] = places[0]
            at[buckets[0]] += way
            return
        order = np.argsort(buckets, kind="stable")
        sorted_buckets = buckets[order]
        runs = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
        counts = np.diff(np.append(runs, len(order)))
        which = sorted_buckets[runs]
        within = np.arange(len(order)) - np.repeat(runs, counts)
        sa[np.repeat(at[which], counts) + way * within] = places[order]
        at[which] += way * counts

    def _before(self, wave: np.ndarray, small: bool) -> np.ndarray:
        """Places before those of a wave, of one type."""
        wave = wave[~self.first[wave]] - 1
        return wave[self.small[wave] == small]

    def _waves(self, sa: np.ndarray, wave: np.ndarray, symbol: int, small: bool, at: np.ndarray, way: int) -> None:
        """Induces from entries of one symbol's buckets, and from what these induce into the same buckets."""
        while len(wave):
            wave = self._before(wave, small)
            if len(wave):
                self._put(sa, wave, at, way)
                wave = wave[self.text[wave] == symbol]

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All places in order, given LMS places in order.

        A step takes the buckets of several symbols at once as long as none of them induces into another of these, which
        makes a text of many rare symbols as quick as one of few.
        """
        sa = np.full(self.n, -1, np.int32)
        tails = self.begins[1:] - 1
        self._put(sa, lms[::-1], tails, -1)
        heads = self.begins[:-1].copy()
        steps, symbols, last = self.steps, self.symbols, len(self.symbols)
        i, width = 0, 1
        while i < last:
            j = min(i + width, last)
            part = sa[steps[i] : steps[j]]
            part = part[part >= 0]
            wave, grow = self._before(part, False), 2
            if len(wave):
                low = int(np.searchsorted(symbols, self.text[wave].min()))
                if low == i:
                    part = sa[steps[i] : steps[i + 1]]
                    part = part[part >= 0]
                    is_small = self.small[part]
                    # larger suffixes stand before the LMS ones of their bucket
                    self._waves(sa, part[~is_small], symbols[i], False, heads, 1)
                    wave, j, grow = self._before(part[is_small], False), i + 1, 1
                elif low < j:
                    grow = 1
                    part, j = sa[steps[i] : steps[low]], low
                    wave = self._before(part[part >= 0], False)
                if len(wave):
                    self._put(sa, wave, heads, 1)
            i, width = j, grow * (j - i)
        # smaller ones are placed again, from the right; the end of a group stays
        ends = sa[: steps[1]].copy()
        found = sa >= 0
        found[found] = self.small[sa[found]]
        sa[found] = -1
        sa[: steps[1]] = ends
        tails = self.begins[1:] - 1
        i, width = last, 1
        while i > 1:
            j = max(i - width, 1)
            part = sa[steps[j] : steps[i]]
            part = part[part >= 0][::-1]
            wave, grow = self._before(part, True), 2
            if len(wave):
                high = int(np.searchsorted(symbols, self.text[wave].max()))
                if high == i - 1:
                    part = sa[steps[i - 1] : steps[i]]
                    part = part[part >= 0][::-1]
                    is_small = self.small[part]
                    self._waves(sa, part[is_small], symbols[i - 1], True, tails, -1)
                    wave, j, grow = self._before(part[~is_small], True), i - 1, 1
                elif high >= j:
                    grow = 1
                    part, j = sa[steps[high + 1] : steps[i]], high + 1
                    wave = self._before(part[part >= 0][::-1], True)
                if len(wave):
                    self._put(sa, wave, tails, -1)
            i, width = j, grow * (i - j)
        return sa

    def named(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LMS places group by group in the order of their substrings, and their names within the group."""
        lms = lms[np.argsort(self.group[lms], kind="stable")]
        all_lms = np.flatnonzero(self.lms)
        number = np.empty(self.n, np.int32)
        number[all_lms] = np.arange(len(all_lms))
        # up to the next LMS place, that one included; the end of a group is alone
        length = np.append(np.diff(all_lms), 0) + 1
        length[self.text[all_lms] == END] = 1
        left, right = lms[:-1], lms[1:]
        size = length[number[right]]
        same = (size == length[number[left]]) & (self.group[left] == self.group[right])
        pairs, d = np.flatnonzero(same), 0
        while len(pairs):
            pairs = pairs[d < size[pairs]]
            differ = self.text[left[pairs] + d] != self.text[right[pairs] + d]
            same[pairs[differ]] = False
            pairs, d = pairs[~differ], d + 1
        new_group = np.concatenate([[True], self.group[left] != self.group[right]])
        steps = np.cumsum(np.concatenate([[True], ~same]))
        counts = np.diff(np.append(np.flatnonzero(new_group), len(lms)))
        return lms, steps - np.repeat(steps[new_group], counts)


def suffix_array(text: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of all suffixes, laid out by first symbol and then group, in order inside each such bucket.

    ``text`` holds symbols from zero; each group (numbered from zero, in order) ends with the only zero in it.
    """
    level = _Level(text, group)
    sa = level.induce(np.flatnonzero(level.lms))
    placed = sa[level.lms[sa]]
    lms, names = level.named(placed)
    unique = np.concatenate([[True], np.diff(names) != 0]) if len(names) else np.zeros(0, bool)
    groups = level.group[lms]
    # only groups in which a name repeats are sorted further
    repeated = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    repeated[groups[~unique & np.concatenate([[False], groups[1:] == groups[:-1]])]] = True
    if repeated.any():
        of = np.flatnonzero(repeated[groups])
        name_at = np.zeros(level.n, np.int32)
        name_at[lms] = names
        places = np.sort(lms[of])
        renumbered = (np.cumsum(repeated) - 1)[level.group[places]]
        inner = suffix_array(name_at[places], renumbered)
        ordered = places[inner]
        lms[of] = ordered[np.argsort(level.group[ordered], kind="stable")]
    return level.induce(lms)


def common_prefixes(text: np.ndarray, group: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For every place, how much of it, up to ``most``, the suffix before it in its bucket shares.

    Permuted: strings (their ``starts`` and ``sizes``) are run through from the left, all in step, and a place shares at
    least what the place before it does, less one.  Prefixes end where their string does.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    alike = (text[sa[1:]] == text[sa[:-1]]) & (group[sa[1:]] == group[sa[:-1]])
    before[sa[1:][alike]] = sa[:-1][alike]
    shared = np.zeros(n, np.int16)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    length = np.zeros(len(starts), np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(starts)
    for t in range(longest):
        while sizes[active - 1] <= t:
            active -= 1
        here = starts[:active] + t
        other = before[here].astype(np.int64)
        known = length[:active]
        np.maximum(known - 1, 0, out=known)
        known[other < 0] = 0
        growing = np.flatnonzero((other >= 0) & (known < most))
        while len(growing):
            x, y = here[growing] + known[growing], other[growing] + known[growing]
            growing = growing[(text[x] == text[y]) & (text[x] > CUT)]
            known[growing] += 1
            growing = growing[known[growing] < most]
        shared[here] = known
    return shared


def laid_out(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and groups of all places, and where each string starts and how long it is."""
    strings = [s for g in groups for s in g]
    counts = np.fromiter(map(len, groups), np.int64, len(groups))
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    own = np.repeat(np.arange(len(groups)), counts)
    # a cut behind every string, and an end behind every group
    starts = np.cumsum(sizes + 1) - sizes - 1 + own
    text = np.full(int(sizes.sum()) + len(strings) + len(groups), END, np.int32)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(starts, sizes) + inner] = flat.astype(np.int32) + SHIFT
    text[starts + sizes] = CUT
    per_group = np.bincount(own, sizes + 1, len(groups)).astype(np.int64) + 1
    return text, np.repeat(np.arange(len(groups), dtype=np.int32), per_group), starts, sizes


def equal_windows(groups: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows that are equal to another one of their group, and their classes; starts and sizes of strings.

    Places count through all strings laid out; two of them have one class if and only if their windows are equal and
    of one group.
    """
    text, group, starts, sizes = laid_out(groups)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), starts, sizes
    sa = suffix_array(text, group)
    shared = common_prefixes(text, group, sa, starts, sizes, window)
    linked = shared[sa] >= window
    member = linked | np.append(linked[1:], False)
    classes = np.cumsum(~linked)
    return sa[member], classes[member], starts, sizes
