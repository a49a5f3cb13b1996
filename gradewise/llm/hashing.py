"""Vectorised hashes of spans of bytes, modulo 2**64.

With S the prefix sums of value * FACTOR**i, the span [b, e) hashes to
(S[e] - S[b]) / FACTOR**b, so all spans of a buffer cost one pass over it.
"""

from __future__ import annotations

import numpy as np

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)

_powers = {FACTOR: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1; kept up to the longest buffer seen."""
    if _powers[base].size < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over all others; one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Spans:
    """Hashes of spans of one byte buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(data.size, FACTOR), out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * powers(self.sums.size, INVERSE)[begin]
                     + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
