"""Words of many texts at once: hashes by prefix sums over one byte buffer."""

from __future__ import annotations

import numpy as np

from scriptorium.llm.bytehash import Windows, mix

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 64, np.uint64) * _U(2) + _U(1)


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each lower-cased word of the texts, in order."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[buf]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Windows(buf).hash(begins, ends - begins), np.searchsorted(starts, begins, "right") - 1


def shingles(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``width`` words of one text, repeats included."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(n, _U)
    for k in range(width):
        h += words[k : k + n] * _FACTORS[k]
    same = owner[:n] == owner[width - 1 :]
    return mix(h[same]), owner[:n][same]


def split(text: bytes) -> list[bytes]:
    """The same words one by one (ASCII letters lower-cased, ASCII white space apart)."""
    return text.lower().split()
