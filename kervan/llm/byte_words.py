"""Vectorised words and hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes that are not ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and all bytes of other letters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: ASCII lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        factor = _BASE if kind == "up" else _INVERSE
        have = np.full(max(n, 1 << 20), factor, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of h."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words (runs of bytes in `table`) of texts that lie end to end in raw, with offsets."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[raw]
        before = np.empty(len(raw), bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        before[edges] = False
        if len(raw):
            before[0] = False
        behind = np.empty(len(raw), bool)
        behind[:-1] = inside[1:]
        if len(raw):
            behind[-1] = False
        behind[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~behind) + 1
        #: For each text, the place of its first word; one more at the end.
        self.bounds = np.searchsorted(self.start, offsets)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw)), out=self._sums[1:])
        self._down = _power("down", len(raw) + 1)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first `prefix` bytes (the whole word where it is shorter)."""
        return self.of(self.start, self.end if prefix is None else np.minimum(self.end, self.start + prefix))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes from each start to its end."""
        return mix64((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
