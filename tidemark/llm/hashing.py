"""Vectorised 64-bit hashing of byte strings, shared by the text operators.

Everything works on one buffer that holds many documents: a prefix hash H is
built once, and the hash of any span [i, j) is then two look-ups and one
multiplication (mod 2**64, the base is odd and so invertible).
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or BASE**-i) mod 2**64 for i < n, kept between calls."""
    name = "inv" if inverse else "pow"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = pow(BASE, -1, 1 << 64) if inverse else BASE
        size = max(n, 1 << 16)
        out = np.full(size, base & _MASK, dtype=np.uint64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix(buffer: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (buffer[j] + 1) * BASE**j over j < i."""
    out = np.empty(len(buffer) + 1, dtype=np.uint64)
    out[0] = 0
    terms = (buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer))
    np.cumsum(terms, out=out[1:])
    return out


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end) of the buffer behind ``h``."""
    inverse = powers(len(h), inverse=True)
    return mix((h[end] - h[start]) * inverse[start])
