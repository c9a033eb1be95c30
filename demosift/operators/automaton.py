"""All keys of a dictionary that occur in a text, in one pass (Aho and Corasick 1975), over arrays.

The trie's transitions are one sorted array of (node, character); each node knows the longest other node that ends
in the same characters (its fail) and the nearest such node that is a key (its link).  Nodes are made level by level,
and many texts are read in step, so both building and matching work on whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A code point takes fewer bits.
_BITS = 21


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Automaton:
    codes: np.ndarray
    child: np.ndarray
    fail: np.ndarray
    link: np.ndarray
    size: np.ndarray
    is_key: np.ndarray

    @staticmethod
    def of(keys: list[str]) -> Automaton:
        """Over distinct, non-empty keys."""
        points = [code_points(k) for k in keys]
        lengths = np.fromiter(map(len, points), np.int64, len(points))
        order = np.argsort(-lengths, kind="stable")
        points, lengths = [points[i] for i in order.tolist()], lengths[order]
        flat = np.concatenate([*points, np.zeros(0, np.uint32)]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        node = np.zeros(len(points), np.int64)
        codes, parents, letters, sizes = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        levels, n = [0, 1], 1
        for depth in range(int(lengths[0]) if len(lengths) else 0):
            # keys that go on are in front
            active = int(np.searchsorted(-lengths, -depth, side="left"))
            code, of = np.unique(node[:active] << _BITS | flat[starts[:active] + depth], return_inverse=True)
            node[:active] = n + of
            codes.append(code)
            parents.append(code >> _BITS)
            letters.append(code & (1 << _BITS) - 1)
            sizes.append(np.full(len(code), depth + 1))
            n += len(code)
            levels.append(n)
        is_key = np.zeros(n, bool)
        is_key[node] = len(points) > 0
        # levels follow each other, so transitions are in order of their nodes
        found = Automaton(np.concatenate([*codes, np.zeros(0, np.int64)]), np.arange(1, n, dtype=np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.concatenate(sizes).astype(np.int32), is_key)
        parent, letter = np.concatenate(parents), np.concatenate(letters)
        for a, b in zip(levels[2:-1], levels[3:], strict=True):
            found.fail[a:b] = found.step(found.fail[parent[a:b]].astype(np.int64), letter[a:b])
            to = found.fail[a:b]
            found.link[a:b] = np.where(is_key[to], to, found.link[to])
        return found

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The longest nodes that end in a state's characters and the letter."""
        out, waiting = np.zeros(len(states), np.int64), np.arange(len(states))
        states = states.astype(np.int64)
        while len(waiting) and len(self.codes):
            code = states[waiting] << _BITS | letters[waiting]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            out[waiting[hit]] = self.child[at[hit]]
            waiting = waiting[~hit & (states[waiting] != 0)]
            states[waiting] = self.fail[states[waiting]]
        return out

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and length of every occurrence of a key, ordered by them."""
        points = [code_points(t) for t in texts]
        lengths = np.fromiter(map(len, points), np.int64, len(points))
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([*[points[i] for i in order.tolist()], np.zeros(0, np.uint32)]).astype(np.int64)
        ordered = lengths[order]
        begins = np.cumsum(ordered) - ordered
        state = np.zeros(len(texts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(int(ordered[0]) if len(ordered) else 0):
            active = int(np.searchsorted(-ordered, -at, side="left"))
            state[:active] = self.step(state[:active], flat[begins[:active] + at])
            own = np.arange(active)
            here = np.where(self.is_key[state[:active]], state[:active], self.link[state[:active]])
            while len(own := own[here > 0]):
                here = here[here > 0]
                size = self.size[here]
                found.append((order[own], at + 1 - size, size))
                here = self.link[here]
        text, start, size = (np.concatenate([*[f[i] for f in found], np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))
        by = np.lexsort((size, start, text))
        return text[by], start[by], size[by]


def greedy(starts: list[int], sizes: list[int], length: int) -> list[tuple[int, int]]:
    """Starts and sizes of what greedy matching takes: the longest from the left, then those from the right in order.

    A place where nothing starts, or nothing ends, is passed over.
    """
    longest_at: dict[int, int] = {}
    longest_to: dict[int, int] = {}
    for a, n in zip(starts, sizes, strict=True):
        longest_at[a] = max(n, longest_at.get(a, 0))
        longest_to[a + n] = max(n, longest_to.get(a + n, 0))
    forward, backward = [], []
    at = 0
    for a in sorted(longest_at):
        if a >= at:
            forward.append((a, longest_at[a]))
            at = a + longest_at[a]
    end = length
    for e in sorted(longest_to, reverse=True):
        if e <= end:
            backward.append((e - longest_to[e], longest_to[e]))
            end = e - longest_to[e]
    return [*forward, *reversed(backward)]
