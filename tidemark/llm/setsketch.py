"""SetSketch: registers of exponentially spaced truncated minima.

Register i holds floor(1 - log_b(min over elements of an exponential variate)),
cut to 0..Q+1.  The variates come from hashing the element once per register, so
two sketches merge by the maximum of their registers, and two registers agree
with a probability close to the Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

B = 1.001
RATE = 20.0
Q = 65534
REGISTERS = 112
_rng = np.random.default_rng(20210818)
_FACTOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 registers, a row for each set hashes[offsets[k]:offsets[k+1]] (an empty set: zeros)."""
    out = np.zeros((len(offsets) - 1, REGISTERS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    low = np.empty((len(full), REGISTERS), dtype=np.uint64)
    starts = offsets[full]
    for i in range(REGISTERS):
        low[:, i] = np.minimum.reduceat(hashes * _FACTOR[i] + _SHIFT[i], starts)
    variate = -np.log1p(-np.maximum(low.astype(np.float64), 1.0) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 24) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches with known set sizes.

    Each register pair is above, below or equal; with p(x) = -log_b(1 - x(b-1)/b)
    and shares u, v of the two sizes the chances are p(u - vJ), p(v - uJ) and the
    rest.  The likelihood is concave in J, so the root of its slope is bisected.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    c = (B - 1) / B

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * c) / np.log(B)

    def dp(x):
        return c / (1 - np.clip(x, 1e-12, 1) * c) / np.log(B)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(steps):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        rest = np.maximum(1 - p(x) - p(y), 1e-12)
        slope = -above * v * dp(x) / p(x) - below * u * dp(y) / p(y) + equal * (v * dp(x) + u * dp(y)) / rest
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2
