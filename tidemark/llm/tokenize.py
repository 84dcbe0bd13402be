"""Token ids of whole texts by the word-level BPE of the public tokenizers.

Words are split and merged for many texts at once with array operations: pieces
(runs of letters, single digits, runs of symbols, and seven contractions) are
found by character class, equal pieces are merged once by byte-pair rank, and the
ids are laid out again by text.  A text with a character beyond the Latin blocks
or with the name of a special token goes through the tokenizer as it is.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm.hashing import mix, powers

#: The first code point that is left to the tokenizer; İ lower-cases to two characters.
LATIN_END = 0x250
#: Longer pieces are merged one by one, whether or not they repeat.
LONG = 64
_DOTTED = 0x130
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_SPACES = {0x20, 0x85, 0xA0, *range(0x09, 0x0E)}
_NEVER = np.int64(1) << 60


def _class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))[0]
    return _SPACE if code in _SPACES else _LETTER if kind == "L" else _DIGIT if kind == "N" else _OTHER


_CLASS = np.array([_class_of(c) for c in range(LATIN_END)], dtype=np.uint8)
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(LATIN_END)], dtype=np.uint32)
_loaded: dict[str, WordIds] = {}


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        shown, extra = [], 0
        for b in range(256):
            shown.append(chr(b) if b in plain else chr(256 + extra))
            extra += b not in plain
        suffix = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in shown], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = len(vocab)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        ids = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # open addressing in a table of fixed size: key, rank and id of each merge
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NEVER, dtype=np.int64)
        self.ids = np.zeros(1 << self.bits, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            free = self.keys[slot[left]] == -1
            taken, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[taken], self.ranks[taken], self.ids[taken] = keys[won], won, ids[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    @staticmethod
    def of(path: str) -> WordIds:
        """One for each worker process."""
        if path not in _loaded:
            _loaded[path] = WordIds(path)
        return _loaded[path]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Table slots of the pairs; a slot of rank _NEVER where a pair does not merge."""
        slot = self._slot(keys)
        miss = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            miss = miss[(self.keys[slot[miss]] != keys[miss]) & (self.keys[slot[miss]] != -1)]
        slot[miss] = self._empty()
        return slot

    def _empty(self) -> int:
        return int(np.argmax(self.keys == -1))

    def plain(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of all words at once; gives (ids, word of each id).

        A turn merges the pair of lowest rank of each word, everywhere it occurs.
        Words without a pair to merge leave the work.
        """
        done_ids, done_word = [symbols[:0]], [word[:0]]
        while len(symbols):
            same = word[1:] == word[:-1]
            slot = self._find(symbols[:-1] * self.width + symbols[1:])
            rank = np.append(np.where(same, self.ranks[slot], _NEVER), _NEVER)
            heads = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(symbols)))
            live = np.repeat(least < _NEVER, size)
            done_ids.append(symbols[~live])
            done_word.append(word[~live])
            hit = live & (rank == np.repeat(least, size))
            # of overlapping pairs (three equal symbols) every other one, from the left
            if (hit[1:] & hit[:-1]).any():
                at = np.arange(len(hit))
                since = at - np.maximum.accumulate(np.where(hit, -1, at))
                hit &= since % 2 == 1
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = self.ids[slot[at]]
            live[at + 1] = False
            symbols, word = symbols[live], word[live]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        codes, rows = [], []
        for k, t in enumerate(texts):
            c = np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
            if b"oftext|>" in t or (not t.isascii() and ((c >= LATIN_END) | (c == _DOTTED)).any()):
                out[k] = self.plain(t)
            else:
                codes.append(c)
                rows.append(k)
        gap = np.array([0x20], dtype="<u4")
        flat = np.concatenate([x for c in codes for x in (gap, c)] + [gap])
        kind, low = _CLASS[flat], _LOWER[flat]
        start = np.zeros(len(flat), dtype=bool)
        start[1:] = (kind[1:] != _SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        quote = np.flatnonzero(low == 0x27)
        quote = quote[start[quote]]
        if len(quote):
            padded = np.append(low, [0x20, 0x20])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for which, length in ((quote[one], 2), (quote[two], 3)):
                start[which + 1] = False
                after = which + length
                start[after] |= kind[after] == _LETTER
        at = np.flatnonzero(start)
        filled = np.append(0, np.cumsum(kind != _SPACE))
        end = at + filled[np.append(at[1:], len(flat))] - filled[at]
        h = np.append(np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(len(low))))
        value = mix((h[end] - h[at]) * powers(len(h), inverse=True)[at])
        long = np.flatnonzero(end - at > LONG)  # no two of these count as equal: a polynomial hash lets some long strings share a value
        value[long] = mix(long.astype(np.uint64))
        _, example, which = np.unique(value, return_index=True, return_inverse=True)
        ids, of = self._pieces(low, at[example], end[example])
        count = np.bincount(of, minlength=len(example))
        first = np.cumsum(count) - count
        length = count[which]
        before = np.append(0, np.cumsum(length))
        laid = ids[np.repeat(first[which] - before[:-1], length) + np.arange(before[-1])].astype("<u4")
        edges = np.cumsum([0] + [len(c) + 1 for c in codes])
        edges = before[np.searchsorted(at, edges)]
        for k, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist()):
            out[k] = laid[a:b]
        return out

    def _pieces(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        word = np.repeat(np.arange(len(start)), size)
        code = low[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(word))].astype(np.int64)
        wide = code >= 0x80
        count = 1 + wide
        first = np.cumsum(count) - count
        data = np.empty(int(count.sum()), dtype=np.int64)
        data[first] = np.where(wide, 0xC0 | code >> 6, code)
        data[first[wide] + 1] = 0x80 | code[wide] & 0x3F
        word = np.repeat(word, count)
        last = np.append(word[1:] != word[:-1], True)[: len(word)]
        return self.merge(np.where(last, self.final[data], self.inner[data]), word)
