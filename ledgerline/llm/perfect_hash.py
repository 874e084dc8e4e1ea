"""A minimal perfect hash over pairs of numbers, built and asked in numpy."""

from __future__ import annotations

import numpy as np

from .textkit import mix

_STEP = 0x9E3779B97F4A7C15


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64((level + 1) * _STEP % 2**64)
    h = mix(a ^ turn) + mix(b.astype(np.uint64) * np.uint64(_STEP) + turn)
    return ((mix(h) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots 0 .. n - 1 of n different keys (a, b), of 64 and up to 64 bits.

    Keys are thrown into twice as many places as there are keys; those that are alone in theirs stay, and the others are thrown
    again on the next level. A key's slot is the number of taken places before its own. The keys stand in their
    slots, so a pair that was not among them is told from those that were."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        taken, self.sizes, left = [], [], np.arange(len(a))
        while len(left):
            size = max(64, 2 * len(left))
            at = _place(a[left], b[left], len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            taken.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        self.taken = np.concatenate([*taken, np.zeros(0, bool)])
        self.before = np.cumsum(self.taken) - self.taken
        self.a, self.b, self.n = np.zeros(len(a), a.dtype), np.zeros(len(a), b.dtype), len(a)
        slot = self._slots(a, b)
        self.a[slot], self.b[slot] = a, b

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(a), -1), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(a[left], b[left], level, size)
            here = self.taken[at]
            out[left[here]] = self.before[at[here]]
            left = left[~here]
            base += size
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for one that is no key."""
        out = self._slots(a, b)
        known = np.flatnonzero(out >= 0)
        wrong = known[(self.a[out[known]] != a[known]) | (self.b[out[known]] != b[known])]
        out[wrong] = -1
        return out
