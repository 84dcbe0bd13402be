"""Five-word shingle sets of documents, as sorted 64-bit hashes.

A-Z is lower-cased; words are runs of anything but space and \\x09-\\x0D.  A
document with fewer words than a shingle has its whole sequence as the only
shingle; one without words has none.  A word counts by eight bytes of BLAKE2, and a
shingle mixes those of its words in order, so that no structure of a text, only
chance, lets two shingles share a hash.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np

from tidemark.llm.hashing import mix

WORDS = 5
#: Words whose hashes a worker remembers.
KEPT_WORDS = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


_known = _Hashes()


def _mixed(words: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Hashes of the sequences of ``count`` words from each ``first`` on."""
    out = np.full(len(first), count, dtype=np.uint64)
    for k in range(count):
        out = mix(out * _STEP + words[first + k])
    return out


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of text k are hashes[offsets[k]:offsets[k+1]], ascending."""
    split = [t.lower().split() for t in texts]
    count = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter(map(_known.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=int(count.sum()))
    if len(_known) > KEPT_WORDS:
        _known.clear()
    first = np.cumsum(count) - count
    size = np.maximum(count - words + 1, 0)
    row = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]
    short = [np.flatnonzero(count == n) for n in range(1, words)]
    hashes = np.concatenate([_mixed(flat, at, words), *(_mixed(flat, first[s], n) for n, s in enumerate(short, 1))])
    doc = np.concatenate([row, *short])
    if any(map(len, short)):
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))
