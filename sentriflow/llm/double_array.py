"""Double-array tries over word numbers, advanced for all positions of a text at once."""

from __future__ import annotations

import numpy as np

#: Free places that are tried for a node with several children, first the lowest and then any, before it goes to the end.
_TRIES = 256


class DoubleArray:
    """Phrases of numbers from 1 up. From state s, number c leads to t = base[s] + c if check[t] == s; accept[t] is the phrase that ends at t, or -1. State 0 is the root."""

    def __init__(self, base: np.ndarray, check: np.ndarray, accept: np.ndarray):
        self.base, self.check, self.accept = base, check, accept

    @classmethod
    def build(cls, phrases: list[tuple[int, ...]]) -> DoubleArray:
        """Phrase i is accepted as number i; phrases differ."""
        order = sorted(range(len(phrases)), key=phrases.__getitem__)
        size = max(16, 2 * sum(map(len, phrases)) + max((max(p) for p in phrases), default=0) + 2)
        base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], end, head = 0, 1, 1  # `end`: all places from here on are free; `head`: none below is
        level, draw = [(0, 0, len(order))], np.random.default_rng(len(phrases))
        for depth in range(max(map(len, phrases), default=0)):
            nodes = []
            for state, lo, hi in level:
                kids: list[list[int]] = []
                for i in range(lo, hi):
                    p = phrases[order[i]]
                    if len(p) > depth:
                        if not kids or kids[-1][0] != p[depth]:
                            kids.append([p[depth], i, i + 1])
                        kids[-1][2] = i + 1
                if kids:
                    nodes.append((state, kids))
            nodes.sort(key=lambda x: -len(x[1]))
            level = []
            for state, kids in nodes:
                c = np.array([k[0] for k in kids])
                if end + int(c[-1]) + 1 >= len(check):
                    more = len(check) + int(c[-1]) + 1
                    base, check, accept = (np.concatenate((x, np.full(more, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (accept, -1)))
                while head < end and check[head] >= 0:
                    head += 1
                at = end
                for near in (np.arange(head, min(end, head + _TRIES)), draw.integers(head, max(end, head + 1), _TRIES)):
                    fits = near[(check[near[:, None] + (c - c[0])[None, :]] < 0).all(1)] if len(near) else near
                    if len(fits):
                        at = int(fits.min())
                        break
                base[state] = at - int(c[0])
                for k, lo, hi in kids:
                    t = at - int(c[0]) + k
                    check[t] = state
                    if len(phrases[order[lo]]) == depth + 1:  # the shortest of a range comes first
                        accept[t] = order[lo]
                    level.append((t, lo, hi))
                end = max(end, at + int(c[-1] - c[0]) + 1)
        return cls(base[:end].copy(), check[:end].copy(), accept[:end].copy())

    def count(self, numbers: np.ndarray, longest: int, phrases: int) -> np.ndarray:
        """How often each phrase occurs in a row of numbers, of which 0 is in no phrase; overlaps count."""
        out = np.zeros(phrases, np.int64)
        numbers = np.concatenate((numbers, np.zeros(longest, numbers.dtype)))
        at = np.flatnonzero(numbers)
        state = np.zeros(len(at), np.int64)
        for _ in range(longest):
            c = numbers[at]
            to = self.base[state] + c.astype(np.int64)
            ok = (c > 0) & (to > 0) & (to < len(self.check))
            ok[ok] = self.check[to[ok]] == state[ok]
            at, state = at[ok] + 1, to[ok]
            ends = self.accept[state]
            out += np.bincount(ends[ends >= 0], minlength=phrases)
            if not len(at):
                break
        return out
