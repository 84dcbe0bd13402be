"""Quality rules by compression bands, beside counts over words and lines (operator 5).

A text is compressed with zstandard as a whole and in fixed chunks.  Repetitive
text compresses too well, incompressible text hardly at all; what is too much
depends on the length, so limits come from a table by bytes.  A text is kept if it
passes the base rules, its whole ratio is within the limits of its length, and no
more than ``CHUNK_SHARE`` of its chunks lie outside those of a chunk.

Null texts have no words: they fail the base rules.  Repeated rows are judged each
for itself.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, slices, strings

#: (bytes from, least ratio, most ratio): limits of whole texts by length, between prose and
#: random words of a 64-letter alphabet.  Under 150 bytes the two overlap (prose of the test
#: tables has up to 1.09, random text from 0.95), so there only repetition is rejected.
LIMITS = (
    (0, 0.0, 9.0),
    (60, 0.50, 9.0),
    (100, 0.40, 9.0),
    (150, 0.38, 0.87),
    (200, 0.35, 0.85),
    (300, 0.33, 0.78),
    (400, 0.30, 0.74),
    (800, 0.26, 0.70),
    (1600, 0.22, 0.70),
    (3200, 0.18, 0.70),
    (6400, 0.14, 0.70),
    (12800, 0.10, 0.70),
)
CHUNK = 2048
CHUNK_LIMITS = (0.20, 0.70)
CHUNK_SHARE = 0.5
LEVEL = 3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == len(words):
        return 0
    key, base, packed = ids[:n].copy(), max(len(known), 2), max(len(known), 2)
    for k in range(1, width):
        if packed > (1 << 62) // base:  # exact: number the windows so far before going on
            _, key = np.unique(key, return_inverse=True)
            packed = int(key.max()) + 1
            if packed > (1 << 62) // base:
                raise OverflowError("text too long")
        key = key * base + ids[k : k + n]
        packed *= base
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def _limits(size: int) -> tuple[float, float]:
    low, high = LIMITS[0][1:]
    for at, *limits in LIMITS:
        if size >= at:
            low, high = limits
    return low, high


def bands(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks, chunks outside their limits, within all limits)."""
    if not text:
        return 0.0, 0, 0, True
    whole = len(compressor.compress(text)) / len(text)
    low, high = _limits(len(text))
    # the last chunk ends with the text and so may overlap the one before
    starts = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK] if len(text) > CHUNK else []
    parts = [text[a : a + CHUNK] for a in starts]
    outside = sum(not CHUNK_LIMITS[0] <= len(compressor.compress(p)) / CHUNK <= CHUNK_LIMITS[1] for p in parts)
    return whole, len(parts), outside, low <= whole <= high and outside <= CHUNK_SHARE * len(parts)


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in slices(batches, "t"):
        rows = []
        for text in strings(batch.column("t")):
            words = text.split()
            n, repeats = len(words), repeated_words(words)
            chars = sum(map(len, words)) if text.isascii() else len(text.translate(None, _SPACES).decode("utf-8", "replace"))
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            ratio, parts, outside, within = bands(text, compressor)
            rows.append((n, chars, len(text) - len(text.translate(None, _SYMBOLS)), duplicate_lines(text), repeats, failed, within and not failed, ratio, parts, outside))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        keep = [c for c in batch.schema.names if c != "t"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *(x.split()[0] for x in _OUT.split(", "))])


def judged(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept and the compression figures."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return few_rows(docs.select("doc_id", F.col("text").alias("t"))).mapInArrow(_judge, f"doc_id {kind}, {_OUT}")


def passing(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row at least and so one step: a slice is judged in one piece
        for batch in slices(batches, "text"):
            texts = pa.RecordBatch.from_arrays([batch.column("text")], names=["t"])
            for judged_batch in _judge(iter([texts])):
                yield batch.filter(judged_batch.column("kept"))

    return few_rows(docs).mapInArrow(keep, docs.schema)
