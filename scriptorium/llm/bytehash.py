"""Hashes of many windows of a byte buffer at once, from prefix sums.

H(p, n) = sum(R[b[p+k]] * B**k for k < n) mod 2**64, with B odd and R a table of 256 random
values: two prefix sums and one product give the hash of any window. Two independent
tables and bases give 128 bits.
"""

from __future__ import annotations

import numpy as np

_SEEDS = ((0x9E3779B97F4A7C15, 11), (0xD1B54A32D192ED03, 23))
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest buffer so far."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = _SEEDS[which][0]
        inverse = pow(base, -1, 1 << 64)
        grow = lambda b: np.multiply.accumulate(np.concatenate(([_U(1)], np.full(max(n, 1 << 16) - 1, b, _U))))
        _powers[which] = have = (grow(base), grow(inverse))
    return have


class Windows:
    def __init__(self, buf: np.ndarray, which: int = 0):
        table = np.random.Generator(np.random.PCG64(_SEEDS[which][1])).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
        up, self.down = _power(which, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(table[buf] * up[: len(buf)], out=self.sums[1:])

    def hash(self, at: np.ndarray, n) -> np.ndarray:
        """Of the windows of ``n`` bytes (a number or an array) that begin at ``at``."""
        return mix((self.sums[at + n] - self.sums[at]) * self.down[at])
