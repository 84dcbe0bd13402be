"""Repeated-substring removal with a run-length index (operator 3).

Every window of ``length`` bytes is represented by the smallest hash of the
``anchor``-byte strings inside it, so equal windows share that hash.  Successive
windows with the same smallest hash form a *run*; its bytes are its context.

1. Runs whose hash occurs once in all are dropped: no window of theirs is repeated.
2. Equal contexts are counted as one; one that occurs twice or more is repeated
   as a whole, and where a hash has no other context that settles it.
3. Other hashes are dealt to buckets of a few MB.  Each bucket gets a
   run-length index (:class:`tidemark.llm.rindex.RunIndex`); streaming the
   matching statistics marks the strings that also start elsewhere.
4. A hash with more than ``hot_bytes`` of different contexts never meets in one
   task: its windows are counted one by one with partial aggregation instead.
5. Marks go back to every document with an equal context and are merged.

Nulls count as empty texts, and texts under ``length`` bytes are left alone.
Repeated rows repeat each other's strings, so all their long-enough bytes go.
An empty table gives an empty result.  Other columns of ``docs`` stay as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidemark.llm.common import bytes_of, few_rows, save, slices, strings, text_hash
from tidemark.llm.hashing import mix, powers, prefix
from tidemark.llm.rindex import RunIndex

LENGTH = 400
ANCHOR = 100
#: Bytes of contexts in one index, and the most that one hash may bring there.
BUCKET_BYTES = 1 << 20
HOT_BYTES = 2 << 20

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0x1FFFFFFFFFFFFFFF)


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values (block-wise running minima)."""
    n = len(hashes) - width + 1
    blocks = np.concatenate([hashes, np.full(-len(hashes) % width, _LAST)]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Runs of windows in a buffer of documents.

    Gives (document, hash, context hash, start in the document, bytes, times that
    the hash occurs in the run); a periodic text can repeat itself in one run.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    h = prefix(data)
    n = len(data) - anchor + 1
    anchors = mix((h[anchor:] - h[:n]) * powers(len(data) + 1, inverse=True)[:n])
    small = window_minima(anchors, length - anchor + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(small)]
    fits = np.arange(len(small)) + length <= offsets[1:][doc]
    new = np.ones(len(small), dtype=bool)
    new[1:] = (small[1:] != small[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new & fits)
    stop = np.minimum(np.append(start[1:], len(small)), offsets[1:][doc[start]] - length + 1)
    size = stop + length - 1 - start
    # only values that can be a minimum need counting
    least = np.flatnonzero(anchors <= max(small.max(), _LOW))
    low, high = np.searchsorted(least, start), np.searchsorted(least, start + size - anchor, side="right")
    count = high - low
    run = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low[run]
    times = np.bincount(run[anchors[least[at]] == small[start][run]], minlength=len(start))
    # a context is named by a digest of its bytes: a polynomial hash lets some long strings share a name
    context = np.array([xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())], dtype=np.uint64)
    return doc[start], small[start], context, start - offsets[doc[start]], size, times


def _runs(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            doc, key, context, start, size, times = runs_of(*bytes_of(batch.column("t")), length, anchor)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(pa.array(doc)), batch.column("k").take(pa.array(doc)), *(pa.array(x.view(np.int64)) for x in (key, context)), pa.array(start), pa.array(size), pa.array(times)],
                names=["i", "k", "h", "c", "a", "n", "r"],
            )

    return run


def _index(length: int):
    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("c", "ascending")])
        found = RunIndex(strings(table.column("bytes").combine_chunks()), length).repeated() if table.num_rows else []
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        marks = [m for x in found for m in x]
        return table.select(["h", "c", "n"]).take(pa.array(rows)).append_column("s", pa.array([m[0] for m in marks], pa.int64())).append_column("e", pa.array([m[1] for m in marks], pa.int64()))

    return index


def _windows(length: int):
    """Each window of each context with the halves of a 128-bit digest of its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 16):
            data, offsets = bytes_of(batch.column("bytes"))
            count = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[row] + at
            names = np.frombuffer(b"".join([xxh3_128_digest(data[a : a + length]) for a in start.tolist()]), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), *(batch.column(x).take(pa.array(row)) for x in ("h", "c", "n", "m")), pa.array(at)], names=["w1", "w2", "h", "c", "n", "m", "s"])

    return windows


def marks(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Repeated bytes by row key: i (doc_id), k (text hash), spans array<struct<s,e>>, unmerged."""
    texts = docs.select(F.col("doc_id").alias("i"), text_hash().alias("k"), F.col("text").alias("t")).where(F.octet_length("t") >= length)
    id_type = texts.schema["i"].dataType.simpleString()
    runs = save(few_rows(texts).mapInArrow(_runs(length, anchor), f"i {id_type}, k long, h long, c long, a long, n long, r long"), "runs")
    shared = runs.groupBy("h").agg(F.sum("r").alias("total"), ((F.min(F.struct("c", "n")) != F.max(F.struct("c", "n"))) | (F.count("*") == 1)).alias("differ")).where("total > 1").drop("total")
    live = save(runs.drop("r").join(shared, "h"), "live")
    whole = live.where("not differ").select("i", "k", F.col("a").alias("s"), (F.col("a") + F.col("n")).alias("e"))

    classes = live.where("differ").groupBy("h", "c", "n").agg(F.count("*").alias("m"), F.min(F.struct("i", "k", "a")).alias("at"))
    sizes = classes.groupBy("h").agg(F.sum("n").alias("load"))
    classes = classes.join(sizes, "h").select("h", "c", "n", "m", "at.*", (F.col("load") > hot_bytes).alias("hot"))
    cut = F.expr("substring(cast(t as binary), cast(a + 1 as int), cast(n as int))")
    same = F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2"))
    contexts = classes.withColumnsRenamed({"i": "i2", "k": "k2"}).join(texts, same).select("h", "c", "n", "m", "hot", cut.alias("bytes")).dropDuplicates(["h", "c", "n"])
    contexts = save(contexts, "contexts")
    cold, hot = contexts.where("not hot"), contexts.where("hot")
    buckets = 1 + int((cold.agg(F.sum("n")).first()[0] or 0) // bucket_bytes)
    found = cold.select("h", "c", "n", "bytes", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("b")).groupBy("b").applyInArrow(_index(length), "h long, c long, n long, s long, e long")
    windows = hot.mapInArrow(_windows(length), "w1 long, w2 long, h long, c long, n long, m long, s long")
    often = windows.groupBy("w1", "w2").agg(F.sum("m").alias("times")).where("times > 1").drop("times")
    single = windows.join(often, ["w1", "w2"]).select("h", "c", "n", "s", (F.col("s") + length).alias("e"))
    equal = contexts.where("m > 1").select("h", "c", "n", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    found = save(found.unionByName(single).unionByName(equal).groupBy("h", "c", "n").agg(F.collect_list(F.struct("s", "e")).alias("r")), "repeated")
    partly = live.where("differ").join(found, ["h", "c", "n"]).select("i", "k", "a", F.explode("r").alias("r")).select("i", "k", (F.col("a") + F.col("r.s")).alias("s"), (F.col("a") + F.col("r.e")).alias("e"))
    # a document's marks are bounded by its own length
    return whole.unionByName(partly).groupBy("i", "k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def merged(spans_: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for x in spans_ or ():
        if out and x["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["e"])
        else:
            out.append([x["s"], x["e"]])
    return [(s, e) for s, e in out]


def whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans widened to the characters that they touch."""
    out: list[tuple[int, int]] = []
    for s, e in gone:
        while s and text[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        out.append((s, e))
    return out


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)])) if gone else text


def _rest(text: bytes, gone: list[tuple[int, int]]) -> str:
    return _kept(text, whole_characters(text, gone)).decode()


def _with_marks(docs: DataFrame, **options) -> DataFrame:
    """row (all columns of docs), t, spans."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), text_hash().alias("k"), F.col("text").alias("t"))
    found = marks(docs, **options).withColumnsRenamed({"i": "i2", "k": "k2"})
    return rows.join(found, F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")), "left").select("row", "i", "t", "spans")


def removed(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed byte ranges), text.

    ``text`` is the rest as characters: one that loses a byte goes whole.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            texts = strings(batch.column("t"))
            gone = [merged(x) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("i"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(e - s for s, e in g) for g in gone], pa.int64()),
                    pa.array([len(g) for g in gone], pa.int64()),
                    pa.array([hashlib.sha256(_kept(t, g)).hexdigest() for t, g in zip(texts, gone)], pa.string()),
                    pa.array([[{"s": s, "e": e} for s, e in g] for g in gone], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    pa.array([_rest(t, g) for t, g in zip(texts, gone)], pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_marks(docs.select("doc_id", "text"), **options).select("i", "t", "spans").mapInArrow(report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>, text string")


def strip(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated strings cut from ``text``; a character that loses a byte goes whole; null stays null."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            new = [t if s is None or t is None else _rest(t.encode(), merged(s)) for t, s in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "t"])

    marked = _with_marks(docs, **options).select("row", "t", "spans")
    row = marked.schema["row"].dataType
    cut = marked.mapInArrow(rest, StructType([StructField("row", row), StructField("t", StringType())]))
    return cut.select(*(F.col("t").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
