"""Byte-level BPE of whole texts, both ways, by batched numpy merge rounds (operator 13).

Encoding a batch of texts:

1. A special token's string is cut out first, as the tokenizers library does; the
   rest is split into words by the published pattern.  Words seen before come from
   a table that each worker keeps (``KEPT_WORDS`` words at most, then emptied).
2. The bytes of all new words become one flat array of symbols.  A round finds the
   rank of each changed pair by binary search over the sorted pair keys, merges in
   every word the pair of lowest rank wherever it stands, and sets words without a
   pair to merge aside.  A pair only ever makes pairs of higher rank, so taking all
   its places at once gives what taking them one by one gives.
3. Texts are laid out again as the ids of their words.

Decoding gathers the bytes of all ids of a batch from one flat table; bytes that are
no UTF-8 become U+FFFD and ids without a token are passed over.

Null and empty texts have no ids and decode to the empty text.  Rows are worked on
by themselves: repeated rows, null doc_id and an empty table need no rule, and other
columns are ignored.  Long texts are split piece by piece, cut before white space;
memory grows with the longest text and with its longest word only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import few_rows, slices, strings

#: Words that a worker remembers with their ids, and the longest such word.
KEPT_WORDS = 1 << 17
KEPT_CHARS = 64
#: Characters of one piece of a text.
PIECE_CHARS = 1 << 18
_NEVER = np.int64(1) << 60
_WORDS = regex.compile(public_tokenizers.PATTERN)
_CUT = regex.compile(r"\S(?=\s)", regex.REVERSE)
_loaded: dict[str, ByteBpe] = {}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        shown = byte_alphabet()
        self.symbols = np.array([vocab[c] for c in shown], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        byte_of = {c: b for b, c in enumerate(shown)}
        names = {k: bytes(byte_of[c] for c in name) for name, k in vocab.items()} | {k: name.encode() for name, k in self.special.items()}
        tokens = [names.get(k, b"") for k in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.words: dict[str, bytes] = {}
        self.agreed: set[str] = set()
        self.odd: set[str] = set()
        self.library: Tokenizer | None = None

    @staticmethod
    def of(path: str) -> ByteBpe:
        """One for each worker process."""
        if path not in _loaded:
            _loaded[path] = ByteBpe(path)
        return _loaded[path]

    def _by_library(self, text: str) -> list[str]:
        self.library = self.library or Tokenizer.from_file(self.path)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _split(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        The two libraries know different versions of Unicode: a character is tried
        once, and texts with one on which they differ are split by the tokenizer.
        """
        if not text.isascii():
            new = set(text) - self.agreed
            for c in new:
                trial = f"a{c}{c}1"
                (self.agreed if _WORDS.findall(trial) == self._by_library(trial) else self.odd).add(c)
            if not self.odd.isdisjoint(new):
                return self._by_library(text)
        return _WORDS.findall(text)

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens, in order."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while len(part) - at > PIECE_CHARS:
                # white space after anything else always begins a word
                cut = _CUT.search(part, at, at + PIECE_CHARS) or regex.search(r"\S(?=\s)", part, pos=at + PIECE_CHARS - 1)
                if not cut:
                    break
                yield self._split(part[at : cut.end()])
                at = cut.end()
            if at < len(part):
                yield self._split(part[at:])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word of each id) of the words in one flat array, in order of the words."""
        done = [(symbols[:0], word[:0])]
        if len(symbols):
            rank = np.full(len(symbols), _NEVER)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self._rank(symbols[same], symbols[same + 1])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(heads, len(symbols)))
            least = np.repeat(np.minimum.reduceat(rank, heads), size)
            live = least < _NEVER
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, least = symbols[live], word[live], rank[live], least[live]
                if not len(symbols):
                    break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # of overlapping places every other one, from the left
                place = np.arange(len(hit))
                hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # where they stand now
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            changed = np.unique(np.concatenate([at, at - 1]))
            changed = changed[changed >= 0]
            rank[changed] = _NEVER
            changed = changed[changed < len(symbols) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self._rank(symbols[changed], symbols[changed + 1])
        ids, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, as little-endian unsigned 32-bit numbers."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        symbols = self.symbols[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ids, word = self.merge(symbols, np.repeat(np.arange(len(raw)), size))
        ends = np.cumsum(np.bincount(word, minlength=len(raw))) * 4
        flat = ids.astype("<u4").tobytes()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *ends[:-1].tolist()], ends.tolist())}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        parts = [list(self.pieces(t)) for t in texts]
        new = {w for p in parts for x in p if not isinstance(x, int) for w in x} - self.words.keys()
        if new:
            self.words |= self._learn(sorted(new))
        of = self.words.__getitem__
        ids = [np.frombuffer(b"".join(np.uint32(x).tobytes() if isinstance(x, int) else b"".join(map(of, x)) for x in p), dtype="<u4") for p in parts]
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        for w in new:
            if len(w) > KEPT_CHARS:
                self.words.pop(w, None)
        return ids

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids from offsets[k] to offsets[k + 1]."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.ends))
        ids, before = ids[known], np.append(0, np.cumsum(known))[offsets]
        end = self.ends[ids]
        size = end - np.where(ids > 0, self.ends[ids - 1], 0)
        after = np.cumsum(size)
        flat = self.bytes[np.repeat(end - after, size) + np.arange(after[-1] if len(after) else 0)].tobytes()
        at = np.append(0, after)[before].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def _texts(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in strings(column)]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32()), pa.array(flat))


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ByteBpe.of(path).encode(_texts(batch.column("text"))))], names=["doc_id", "ids"])

    return few_rows(docs.select("doc_id", "text")).mapInArrow(encode, f"doc_id {_kind(docs)}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x or [], dtype=np.int64) for x in batch.column("ids").to_pylist()]
            texts = ByteBpe.of(path).decode(np.concatenate([np.zeros(0, np.int64), *ids]), np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return few_rows(rows.select("doc_id", "ids")).mapInArrow(decode, f"doc_id {_kind(rows)}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that these decode to, in one pass."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bpe = ByteBpe.of(path)
            ids = bpe.encode(_texts(batch.column("text")))
            texts = bpe.decode(np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return few_rows(docs.select("doc_id", "text")).mapInArrow(both, f"doc_id {_kind(docs)}, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``round_trip``'s rows."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
