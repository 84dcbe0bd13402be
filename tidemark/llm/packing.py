"""Best-fit packing of tokenised documents, certified by lower bounds (operator 10).

1. Documents become token ids and one closing id; longer ones than a sequence are
   cut into whole sequences and a rest.
2. Pieces are dealt to partitions of a bounded number; each packs its own by
   best-fit decreasing and gets a lower bound from dual feasible functions.
3. A partition whose bins equal the bound is certified: nothing can pack it
   tighter.  Its bins stay, except for its least filled one.  The pieces of those
   and of all partitions with a gap are dealt anew to fewer partitions and packed
   again, until one partition is left.  Full bins are never opened.

Null texts are empty: a document of the closing id alone.  Repeated rows are packed
each for itself.  An empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, save, slices, strings
from tidemark.llm.tokenize import WordIds

SIZE = 2048
CLOSING_ID = 0
#: Pieces that one partition packs.
PIECES = 100_000
#: Bytes of text that are tokenised together.
STEP = 3 << 19
_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, closing: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids)."""
    end = np.array([closing], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        for batch in slices(batches, "t", STEP):
            rows, number, ids = [], [], []
            for k, raw in enumerate(words.encode(strings(batch.column("t")))):
                raw = raw.tobytes() + end
                parts = [raw[a : a + 4 * size] for a in range(0, len(raw), 4 * size)]
                rows += [k] * len(parts)
                number += range(len(parts))
                ids += parts
            piece = np.array(number, dtype=np.int32)
            columns = [
                batch.column("i").take(pa.array(rows, pa.int64())),
                pa.array(piece),
                pa.array(piece.astype(np.int64) * size),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return few_rows(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))).mapInArrow(cut, f"doc_id {kind}, {_PIECE}" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each piece, and the filled length of each bin.

    Open bins are kept by the room they have left; the bits of one integer say
    which rooms exist, so the tightest fit is its lowest bit from the length up.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    exists, used = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        rest = exists >> n
        if rest:
            left = n + (rest & -rest).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                exists &= ~(1 << left)
        else:
            b, left, used = used, size, used + 1
        where[at], offset[at] = b, size - left
        if left > n:
            room[left - n].append(b)
            exists |= 1 << (left - n)
    return where, offset, np.bincount(where, weights=lengths, minlength=used).astype(np.int64)


def lower_bound(lengths: np.ndarray, size: int, steps: int = 100) -> int:
    """Bins that any packing needs, as the best of two families of dual feasible functions.

    U(e) drops pieces under e and rounds those over size - e up to a bin; u(k)
    rounds (k + 1) x / size down, in k-ths of a bin.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    total = np.concatenate([[0], np.cumsum(count * x)])
    number = np.concatenate([[0], np.cumsum(count)])
    e = np.arange(size // 2 + 1)
    top = size - e + 1
    best = int((-(-(total[top] - total[e]) // size) + number[-1] - number[top]).max())
    for k in range(1, steps + 1):
        exact = (k + 1) * x % size == 0
        value = np.where(exact, k * x, (k + 1) * x // size * size)
        best = max(best, int(-(-(count * value).sum() // (k * size))))
    return best


def _pack(size: int, turn: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        part = table.column("part")[0].as_py()
        where, offset, filled = best_fit(table.column("length").to_numpy(), size)
        certified = len(filled) == lower_bound(table.column("length").to_numpy(), size)
        loose = filled < size if not certified else filled == filled.min()
        base = (turn << 56) + (part << 32)
        for name, values in (("sequence_id", pa.array(base + where)), ("offset", pa.array(offset)), ("open", pa.array(loose[where] & (filled < size)[where]))):
            table = table.append_column(name, values)
        return table.drop_columns(["part"])

    return pack


def packed(found: DataFrame, size: int = SIZE, per_partition: int = PIECES) -> DataFrame:
    """``found`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_PIECE}, sequence_id long, offset long, open boolean"
    rest, done, turn, before = found, [], 0, None
    while True:
        parts = 1 + rest.count() // per_partition
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)))
        now = save(dealt.groupBy("part").applyInArrow(_pack(size, turn), schema), "packed")
        if parts == 1 or parts == before:
            return _all([*done, now]).drop("open")
        done.append(now.where("not open"))
        rest, turn, before = now.where("open").drop("sequence_id", "offset", "open"), turn + 1, parts


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, closing: int = CLOSING_ID, per_partition: int = PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(save(pieces(docs, tokenizer, size, closing), "pieces"), size, per_partition)


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, closing: int = CLOSING_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``size``), doc_ids in order."""
    found = save(pieces(docs, tokenizer, size, closing, with_ids=True), "pieces")
    placed = packed(found.drop("ids"), size).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").withColumn("turn", F.row_number().over(_copies()))
    found = found.withColumn("turn", F.row_number().over(_copies())).withColumnRenamed("doc_id", "i")
    rows = placed.join(found, (F.col("doc_id").eqNullSafe(F.col("i"))) & (placed["piece"] == found["piece"]) & (placed["ids_crc32"] == found["ids_crc32"]) & (placed["turn"] == found["turn"]))
    rows = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("all"))
    return rows.select("sequence_id", F.flatten("all.ids").alias("ids"), F.col("all.doc_id").alias("doc_ids"))


def _copies():
    """Repeated rows of one piece, which are alike and may be matched in any order."""
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy("piece")
