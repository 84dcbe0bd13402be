"""Hard-negative mining by Four-Russians scoring (operator 12).

Every anchor is scored against every row, exactly, as an integer inner product:

1. Vectors become integers, floor(256 x), and are indexed as packed bit planes: for
   each plane (the last one weighs negative) and each group of eight dimensions a
   byte that says which of the eight have that bit.
2. Rows are dealt into blocks of at most about ``BLOCK`` rows of one label class
   (``CLASSES`` hashes of labels), anchors into blocks of ``ANCHORS``; a label with many
   rows has many blocks.  A tile is a block of anchors with a block of rows.
3. For a tile, each anchor and group gets a table of the sums of all 256 subsets of
   its eight components.  Rows look their bytes up and add the sums up plane by plane,
   doubling in between: the full exact scores of the tile.
4. The first pass meets only blocks of one class and keeps each anchor's best rows of
   its own label.  The second meets all blocks and keeps, per anchor and positive,
   the best rows of other labels within the bounds.  A tile hands on its best few
   rows; ranks over them are worked out by window with a limit before the shuffle.

Rows with a null label, a null vector or any null or non-finite component take no part.
Higher scores come first, ties by smaller vec_id (null last).  A repeated row is a row
of its own: it may be its twin's positive.  Shorter vectors are filled up with zeros.
Components beyond ``LIMIT`` raise an error, as scores might leave 64 bits.
An empty table or one without anchors gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, save

BLOCK = 2048
ANCHORS = 256
CLASSES = 32
#: Rows scored at a time inside a tile, so that sums stay in the processor's cache.
CHUNK = 512
#: Largest absolute integer component.
LIMIT = 1 << 22
_TABLE = 256
_NONE = np.int64(np.iinfo(np.int64).min)


def quantised(vector: str) -> Column:
    """floor(256 x) of each component, x as double."""
    return F.expr(f"transform({vector}, x -> cast(floor(256 * cast(x as double)) as bigint))")


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of integers (rows, 8 groups): bit d of a byte is the plane's bit of dimension d."""
    bits = (values[:, None, :] >> np.arange(planes)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sum of every subset of an anchor's components."""
    groups = anchors.T.reshape(-1, 8, len(anchors))
    table = np.zeros((len(groups), _TABLE, len(anchors)), dtype=np.int64)
    for d in range(8):
        np.add(table[:, : 1 << d], groups[:, d : d + 1], out=table[:, 1 << d : 2 << d])
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products by look-ups, plane by plane from the sign down."""
    rows, planes, groups = packed.shape
    out = np.zeros((rows, table.shape[2]), dtype=table.dtype)
    found = np.empty((min(rows, CHUNK), table.shape[2]), dtype=table.dtype)
    for at in range(0, rows, CHUNK):
        part = packed[at : at + CHUNK]
        total, sums = out[at : at + CHUNK], found[: len(part)]
        for b in range(planes - 1, -1, -1):
            for g in range(groups):
                np.take(table[g], part[:, b, g], axis=0, out=sums, mode="clip")
                total += sums
            if b == planes - 1:
                np.negative(total, out=total)
            if b:
                total <<= 1
    return out


def _packed(planes: int, groups: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("q")
            size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            values = np.zeros((len(lists), 8 * groups), dtype=np.int64)
            row = np.repeat(np.arange(len(lists)), size)
            values[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
            flat = pack_planes(values, planes)
            own = batch.column("anchor").to_pylist()
            binary = [pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([x.tobytes() if a else None for x, a in zip(values, own)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "label", "anchor")), *binary], names=["rid", "vec_id", "label", "anchor", "planes", "q"])

    return pack


def _field(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


class _Tile:
    """A row of the tile table: anchors and rows as arrays, and all their scores."""

    def __init__(self, batch: pa.RecordBatch, k: int, planes: int, groups: int, tables: dict):
        self.anchors, self.rows = (batch.column(c)[k].values for c in ("anchors", "rows"))
        at = batch.column("block")[k].as_py()
        if at not in tables:
            tables.clear()
            vectors = np.frombuffer(b"".join(self.anchors.field("q").to_pylist()), dtype=np.int64).reshape(len(self.anchors), -1)
            small = 8 * groups * int(np.abs(vectors).max(initial=0)) << planes < 1 << 31
            tables[at] = subset_sums(vectors).astype(np.int32 if small else np.int64)
        packed = np.frombuffer(b"".join(self.rows.field("planes").to_pylist()), dtype=np.uint8).reshape(len(self.rows), planes, groups)
        self.scores = scores(tables[at], packed).T
        self.same = _field(self.anchors, "label")[:, None] == _field(self.rows, "label")[None, :]


def _positives(count: int, planes: int, groups: int):
    """Each anchor's ``count`` best other rows of its label, within a tile (rows stand by vec_id)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                tile = _Tile(batch, k, planes, groups, tables)
                own, other = _field(tile.anchors, "rid"), _field(tile.rows, "rid")
                left = np.where(tile.same & (own[:, None] != other[None, :]), tile.scores, _NONE)
                every, found = np.arange(len(own)), []
                for _ in range(min(count, len(other))):
                    at = left.argmax(axis=1)  # the first of equal ones
                    score = left[every, at]
                    real = score > _NONE
                    found.append((every[real], at[real], score[real]))
                    left[every, at] = _NONE
                a, r, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([tile.anchors.field("rid").take(pa.array(a)), *(tile.rows.field(c).take(pa.array(r)) for c in ("rid", "vec_id")), pa.array(s)], names=["arid", "rid", "vec_id", "score"])

    return best


def _negatives(count: int, planes: int, groups: int):
    """Each pair's ``count`` best rows of other labels with least <= score <= most, within a tile."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                tile = _Tile(batch, k, planes, groups, tables)
                pairs = tile.anchors.field("pairs")
                of = np.repeat(np.arange(len(pairs)), pairs.value_lengths().to_numpy(zero_copy_only=False))
                pairs = pairs.flatten()
                least, most = _field(pairs, "least"), _field(pairs, "most")
                low, high = np.full(len(tile.anchors), np.iinfo(np.int64).max), np.full(len(tile.anchors), _NONE)
                np.minimum.at(low, of, least)
                np.maximum.at(high, of, most)
                a, r = np.nonzero(~tile.same & (tile.scores >= low[:, None]) & (tile.scores <= high[:, None]))
                s = tile.scores[a, r].astype(np.int64)
                order = np.lexsort((r, -s, a))
                a, r, s = a[order], r[order], s[order]
                begin, end = np.searchsorted(a, np.arange(len(tile.anchors)), "left"), np.searchsorted(a, np.arange(len(tile.anchors)), "right")
                pair, place = [], []
                for p, (x, least_, most_) in enumerate(zip(of.tolist(), least.tolist(), most.tolist())):
                    at = begin[x] + np.searchsorted(-s[begin[x] : end[x]], -most_, "left")
                    for j in range(at, min(at + count, end[x])):
                        if s[j] >= least_:
                            pair.append(p)
                            place.append(j)
                yield pa.RecordBatch.from_arrays([pairs.field("pair").take(pa.array(pair, pa.int64())), *(tile.rows.field(c).take(pa.array(r[place])) for c in ("rid", "vec_id")), pa.array(s[place])], names=["pair", "rid", "vec_id", "score"])

    return best


def _tiles(anchors: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """block (of anchors), anchors, rows: one row per tile; ``anchors`` has the first and last block of rows to meet."""
    wanted = anchors.select("block", "anchors", F.explode(F.sequence("first", "last")).alias("no"))
    return wanted.repartition(parts, "no").join(blocks.hint("merge"), "no").select("block", "anchors", "rows")


def _first(rows: DataFrame, by: str, count: int) -> DataFrame:
    """The ``count`` first rows of each ``by``, with their rank."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mined(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``anchor`` says which rows are anchors.
    A negative of another label fits if its score is ``least`` to ``most`` percent of the positive's.
    """
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
    largest, dims = rows.select(F.expr("aggregate(embedding, 0D, (a, x) -> greatest(a, abs(floor(256 * cast(x as double)))))").alias("top"), F.size("embedding").alias("n")).agg(F.max("top"), F.max("n")).first()
    groups, planes = max(1, -(-(dims or 0) // 8)), int(largest or 0).bit_length() + 1
    if (largest or 0) > LIMIT:
        raise ValueError(f"components over {LIMIT / 256:.0f} in absolute value can't be scored")
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = rows.withColumn("q", quantised("embedding")).drop("embedding")
    index = save(rows.mapInArrow(_packed(planes, groups), f"rid long, vec_id {kinds['vec_id']}, label {kinds['label']}, anchor boolean, planes binary, q binary"), "index")

    # at most CLASSES rows: how many blocks of each kind a class of labels gets
    kind = F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int")
    index = index.withColumn("kind", kind)
    counts = index.groupBy("kind").agg(F.count("*"), F.count_if("anchor")).orderBy("kind").collect()
    before, shares = 0, []
    for c, n, a in counts:
        share = -(-n // BLOCK)
        shares.append((c, before, share, -(-a // ANCHORS) or 1))
        before += share
    shares = vectors.sparkSession.createDataFrame(shares or [(0, 0, 1, 1)], "kind int, first long, share long, sets long")
    dealt = index.join(F.broadcast(shares), "kind")
    number = F.col("first") + F.pmod(F.xxhash64("rid"), F.col("share"))
    blocks = dealt.groupBy(number.alias("no")).agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "rid", "label", "planes"))).alias("rows"))
    parts = max(before, 1)
    blocks = save(blocks, "blocks")
    own = dealt.where("anchor").withColumn("set", F.pmod(F.xxhash64("rid"), F.col("sets")))
    own = save(own.select("rid", "vec_id", "label", "q", "kind", "set", "first", (F.col("first") + F.col("share") - 1).alias("last")), "anchors")

    of_class = own.groupBy("kind", "set", "first", "last").agg(F.collect_list(F.struct("rid", "label", "q")).alias("anchors"))
    of_class = of_class.withColumn("block", F.struct("kind", "set").cast("string"))
    with arrow_rows(vectors.sparkSession, 16):
        best = _tiles(of_class, blocks, parts).mapInArrow(_positives(positives, planes, groups), f"arid long, rid long, vec_id {kinds['vec_id']}, score long")
        best = save(best, "positives")
    best = _first(best, "arid", positives).select("arid", F.col("rid").alias("prid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = best.join(own.select(F.col("rid").alias("arid"), F.col("vec_id").alias("anchor_id")), "arid").withColumn("pair", F.monotonically_increasing_id())
    pairs = save(pairs, "pairs")
    # least <= 100 n / p <= most, in whole numbers; a negative p leaves nothing between
    bounds = F.struct("pair", F.ceil(F.expr(f"cast(positive_score * {least} as decimal(38,0)) / 100")).cast("long").alias("least"), F.floor(F.expr(f"cast(positive_score * {most} as decimal(38,0)) / 100")).cast("long").alias("most"))
    wanted = own.join(pairs.withColumnRenamed("arid", "rid").groupBy("rid").agg(F.collect_list(bounds).alias("pairs")), "rid")
    of_all = wanted.groupBy("kind", "set").agg(F.collect_list(F.struct("rid", "label", "q", "pairs")).alias("anchors"))
    of_all = of_all.select(F.struct("kind", "set").cast("string").alias("block"), "anchors", F.lit(0).cast("long").alias("first"), F.lit(parts - 1).cast("long").alias("last"))
    with arrow_rows(vectors.sparkSession, 16):
        found = _tiles(of_all, blocks, parts).mapInArrow(_negatives(negatives, planes, groups), f"pair long, rid long, vec_id {kinds['vec_id']}, score long")
        found = save(found, "negatives")
    found = _first(found, "pair", negatives).select("pair", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, "pair").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
