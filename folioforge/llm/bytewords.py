"""Words of many UTF-8 texts at once, as numpy arrays.

A word is a maximal run of ASCII digits, ASCII letters (A-Z lower-cased) and
bytes above 0x7F, so no text has to be decoded. Each word gets a 64-bit
polynomial hash from prefix sums; whoever relies on equal hashes compares the
bytes afterwards.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_TEXT = np.ones(256, dtype=bool)
IS_TEXT[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20) + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """``start``/``end`` byte positions, ``row`` and per-row ``counts`` of all words of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD):
        self.low, self.offsets = LOWER[data], offsets
        rows = len(offsets) - 1
        inside = kind[self.low]
        full = offsets[:-1] < offsets[1:]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self._sums: np.ndarray | None = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.low)
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self._sums[1:])
        return self._sums

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Of each word, or of its first ``length`` bytes (the whole word if that is shorter)."""
        sums = self._prefix()
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        h = (sums[end] - sums[self.start]) * powers(_INVERSE, len(self.low) + 1)[self.start]
        return mix(h if length is None else h + np.uint64(length))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def gram(self, i: int, n: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True))

    def code_points(self) -> np.ndarray:
        """Code points before each byte position, from the start of the chunk."""
        sums = np.zeros(len(self.low) + 1, dtype=np.int64)
        np.cumsum((self.low & 0xC0) != 0x80, out=sums[1:])
        return sums


_MANY = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of each run of ``n`` consecutive word hashes; runs that span rows are the caller's to drop."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = hashes[:m].copy()
    for k in range(1, n):
        g *= _MANY
        g += hashes[k : k + m]
    return mix(g)


def words_of(text: str) -> list[bytes]:
    """Words of one text, lower-cased; for small query-side tables."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = Words(data, np.array([0, len(data)], dtype=np.int64))
    return [w.word(i) for i in range(len(w.start))]
