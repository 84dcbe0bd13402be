"""A run-length index over a bounded collection of byte strings (numpy).

The index keeps the Burrows-Wheeler transform as runs, and one suffix-array
sample with a match length at both ends of every run.  That is enough to stream
the matching statistics of the collection against itself: inside a run the
longest match of the next text position is one byte shorter than that of the
position before it, so only run ends need a comparison.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.hashing import prefix, spans

SYMBOL_BITS = 9
PACKED = 7


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only tied suffixes are sorted again.

    ``symbols`` are integers below 2**9.  A suffix that is a prefix of another
    one sorts first.
    """
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACKED, dtype=np.int64)])
    for i in range(PACKED):
        key = (key << SYMBOL_BITS) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    group = np.repeat(heads, np.diff(np.append(heads, n)))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = group
    rank[n] = -1
    tied = order[np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n)))]
    step = PACKED
    while len(tied):
        old = rank[tied]
        key = old * (n + 1) + rank[np.minimum(tied + step, n)] + 1
        by = np.argsort(key)
        tied, key, old = tied[by], key[by], old[by]
        at = np.arange(len(tied))
        new_old = np.ones(len(tied), dtype=bool)
        new_old[1:] = old[1:] != old[:-1]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        start_old = np.maximum.accumulate(np.where(new_old, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = old + start - start_old
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[rank[:n]] = np.arange(n)
    return sa


class RunIndex:
    """Run-compressed BWT of ``texts`` with sampled run ends.

    Attributes: ``run_chars`` and ``run_starts`` (the BWT by runs), ``first`` and
    ``last`` (suffix-array samples at the ends of each run), ``up`` and ``down``
    (lengths of the match of those suffixes with the suffix before and after;
    lengths under ``least`` are kept as 0).
    """

    def __init__(self, texts: list[bytes], least: int):
        self.least = least
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.starts = np.cumsum(np.append(0, self.lengths + 1))[:-1]
        symbols = joined.astype(np.int16) + 1
        symbols[self.starts + self.lengths] = 0
        self.size = len(symbols)
        self.ends = np.repeat(self.starts + self.lengths, self.lengths + 1)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        change = np.ones(len(sa), dtype=bool)
        # every separator is a symbol of its own, so it never joins a run
        change[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        self.run_starts = np.flatnonzero(change)
        self.run_chars = bwt[self.run_starts]
        tail = np.append(self.run_starts[1:], len(sa)) - 1
        self.first, self.last = sa[self.run_starts], sa[tail]
        h = prefix(joined)
        self.up = self._match(h, self.first, sa[np.maximum(self.run_starts - 1, 0)])
        self.down = self._match(h, self.last, sa[np.minimum(tail + 1, len(sa) - 1)])

    def _match(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix within both texts, 0 if under ``least``."""
        out = np.zeros(len(a), dtype=np.int64)
        room = np.minimum(self.ends[a] - a, self.ends[b] - b)
        at = np.flatnonzero((room >= self.least) & (a != b))
        at = at[spans(h, a[at], a[at] + self.least) == spans(h, b[at], b[at] + self.least)]
        a, b, low, high = a[at], b[at], np.full(len(at), self.least), room[at]
        while len(at) and (low < high).any():
            mid = (low + high + 1) // 2
            same = spans(h, a, a + mid) == spans(h, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[at] = low
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that also starts elsewhere.

        Streams over text positions: each takes the value of the last sample at
        or before it, less the distance to it.  Values under ``least`` mean
        "shorter than least".
        """
        best = np.zeros(self.size, dtype=np.int64)
        for at, length in ((self.first, self.up), (self.last, self.down)):
            reach = np.zeros(self.size, dtype=np.int64)
            mark = np.zeros(self.size, dtype=np.int64)
            reach[at] = at + length
            mark[at] = at
            mark = np.maximum.accumulate(mark)
            best = np.maximum(best, reach[mark] - np.arange(self.size))
        return best

    def repeated(self) -> list[list[tuple[int, int]]]:
        """By text: the maximal runs [start, end) of bytes in repeated strings of ``least`` bytes."""
        hit = np.flatnonzero(self.matching_statistics() >= self.least)
        out: list[list[tuple[int, int]]] = [[] for _ in self.lengths]
        if not len(hit):
            return out
        text = np.searchsorted(self.starts, hit, side="right") - 1
        cut = np.ones(len(hit), dtype=bool)
        cut[1:] = (hit[1:] > hit[:-1] + self.least) | (text[1:] != text[:-1])
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(hit)) - 1
        base = self.starts[text[heads]]
        for t, s, e in zip(text[heads].tolist(), (hit[heads] - base).tolist(), (hit[tails] - base + self.least).tolist()):
            out[t].append((s, e))
        return out
