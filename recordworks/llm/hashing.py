"""Rolling hashes over bytes with numpy, for use inside tasks.

The hash of a span is a polynomial over its bytes modulo 2**64, divided by the power at its start and then mixed; any span of a text
costs one subtraction once the prefix sums are there.  Memory is about thirty bytes for each byte of the longest text.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n at least."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Text:
    """The bytes of one text with hashes of its spans."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        powers, _ = _tables(len(self.bytes))
        self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers[: len(self.bytes)], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _tables(len(self.bytes))[1]
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes at each place."""
        n = len(self.bytes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        inverse = _tables(len(self.bytes))[1]
        return mix((self._sums[k:] - self._sums[:-k]) * inverse[:n])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words: runs of bytes other than space and 09-0D."""
        b = self.bytes
        edge = np.zeros(len(b) + 2, np.int8)
        edge[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
        step = np.diff(edge)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words at each place, from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + words[i : i + n])
    return out
