"""SetSketch registers of many sets at once (after Ertl, 2021).

Every element yields increasing points, each for another register; a register
keeps the least point, and points beyond the largest register of their set
are not made.  Registers store the exponent of that minimum to base BASE, cut
to 16 bits.  Equal registers have about the probability of the sets'
similarity; two sketches merge by the larger register.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 128
BASE = 1.02
RATE = 20.0
_LOG = np.log(BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix (splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sketches(elements: np.ndarray, owner: np.ndarray, sets: int, m: int = REGISTERS) -> np.ndarray:
    """Registers [sets, m] of sets given as distinct 64-bit elements with the number of their set."""
    least = np.full(sets * m, np.inf)
    point = np.zeros(len(elements))
    order = mixed(elements ^ np.uint64(0x9E3779B97F4A7C15))
    step, first = (order >> np.uint64(32)) | np.uint64(1), order & np.uint64(0xFFFFFFFF)
    for j in range(m):
        u = (mixed(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64)
        point = point - np.log((u + 1) / (1 << 53)) / (m - j)
        if j:
            wanted = point <= least.reshape(sets, m).max(1)[owner]
            elements, owner, point, step, first = (a[wanted] for a in (elements, owner, point, step, first))
            if not len(owner):
                break
        register = ((first + step * np.uint64(j)) & np.uint64(m - 1)).astype(np.int64)  # odd step: each register once
        np.minimum.at(least, owner * m + register, point)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / _LOG)
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(sets, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, grid: int = 200) -> np.ndarray:
    """Most likely Jaccard similarity of row pairs, jointly from greater, smaller and equal registers."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    total = (size_a + size_b).astype(np.float64)[:, None]
    u, v = size_a[:, None] / total, size_b[:, None] / total
    j = np.linspace(0, 1, grid + 1)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG
    greater, smaller = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = (more * np.log(np.maximum(greater, tiny)) + less * np.log(np.maximum(smaller, tiny))
             + same * np.log(np.maximum(1 - greater - smaller, tiny)))
    return j[np.arange(len(j)), score.argmax(1)]
