"""Near-duplicate documents by banded SetSketch registers (operator 7).

1. Every document gets its set of five-word shingles and a SetSketch.  Documents
   with equal sets form a class, aggregated before anything else is shuffled.
2. Four registers make a band; classes that share a band meet in a bucket.
   A pair at the threshold of 0.85 misses all 28 bands once in 10**9.
3. A shingle that no other class in a bucket has can be in no intersection, which
   bounds what a class may be linked to:  n_y <= c_x (1 + 1/t) - n_x  with n the
   size of a set, c its shingles seen elsewhere and t the threshold.  The bound
   is exact and empties most buckets of texts that are only somewhat alike.
4. Each class is compared with the most central class of each of its buckets.
   Buckets that still hold several components then compare the pairs across
   components that the bound of step 3 allows; in large buckets a sharper bound
   counts only shingles that many have, and pairs that share a rare one meet by it.
5. A pair is first estimated by joint likelihood of the registers and then
   confirmed on the full sets.  Confirmed links give components.

Null texts and texts without words are empty sets: a component of their own.
Rows with a null doc_id link others but never name a component unless all of
its rows are null.  Repeated rows fall in one class.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, save, slices, strings, text_hash
from tidemark.llm.components import components
from tidemark.llm.setsketch import REGISTERS, jaccard, sketches
from tidemark.llm.shingles import shingle_sets

#: Links need PERCENT * |union| <= 100 * |intersection|.
PERCENT = 85
ROWS = 4
#: Buckets of more classes don't compare all pairs that the bound allows.
LARGE = 32
#: In those, a shingle is rare if so many classes have it at most.
RARE = 16
#: Estimates below this are not verified: over nine standard errors under the threshold.
FLOOR = 0.5


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "t"):
        hashes, offsets = shingle_sets(strings(batch.column("t")))
        registers = sketches(hashes, offsets)
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * np.uint64(0xA24BAED4963EE407) ^ (hashes >> np.uint64(31)), out=sums[1:])
        digest = sums[offsets[1:]] - sums[offsets[:-1]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("i"), batch.column("k"), pa.array(np.diff(offsets)), pa.array(digest.view(np.int64)), pa.array([r.tobytes() for r in registers], pa.binary())],
            names=["i", "k", "n", "x", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "t"):
        hashes, offsets = shingle_sets(strings(batch.column("t")))
        yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["x", "shingles"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "shingles"):
        values = [np.frombuffer(s, dtype=np.int64) for s in strings(batch.column("shingles"))]
        rows = np.repeat(np.arange(len(values)), [len(v) for v in values])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), batch.column("x").take(pa.array(rows))], names=["s", "x"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(strings(batch.column(c))), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sketch", "sketch2"))
            estimate = jaccard(a, b, *(batch.column(c).to_numpy().astype(float) for c in ("n", "n2")))
            yield batch.filter(pa.array(estimate >= FLOOR)).select(["x", "y"])


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(strings(batch.column("shingles")), strings(batch.column("shingles2"))):
                both = np.concatenate([np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)])
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    return verify


def sketched(docs: DataFrame) -> DataFrame:
    """Per row: i (doc_id), k (text hash), n (shingles), x (digest of the set), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("i"), text_hash().alias("k"), F.col("text").alias("t"))
    return few_rows(rows).mapInArrow(_sketch, f"i {kind}, k long, n long, x long, sketch binary")


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that estimate and full sets confirm, as edges (a, b)."""
    sketch = classes.select("x", "n", "sketch")
    near = pairs.join(sketch, "x").join(sketch.withColumnsRenamed({"x": "y", "n": "n2", "sketch": "sketch2"}), "y")
    near = near.select("x", "y", "n", "n2", "sketch", "sketch2").mapInArrow(_alike, "x long, y long")
    full = near.join(sets, "x").join(sets.withColumnsRenamed({"x": "y", "shingles": "shingles2"}), "y")
    return full.select("x", "y", "shingles", "shingles2").mapInArrow(_verify(percent), "x long, y long").select(F.col("x").alias("a"), F.col("y").alias("b"))


def class_roots(docs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, root): for every class that is linked to another, the root of its component."""
    classes = rows.where("n > 0").groupBy("x", "n").agg(F.min(F.struct("i", "k")).alias("at"), F.first("sketch").alias("sketch"))
    classes = save(classes, "classes")
    bands = classes.select("x", F.explode(F.expr(f"transform(sequence(0, {REGISTERS // ROWS - 1}), i -> xxhash64(substring(sketch, 1 + i * {2 * ROWS}, {2 * ROWS}), i))")).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("members")).where("size > 1")
    # bands that hold the same classes are one bucket
    shared = shared.groupBy("size", "members").agg(F.min("band").alias("band"))
    buckets = save(bands.join(shared.select("band"), "band"), "buckets")

    near = classes.join(buckets.select("x").distinct(), "x")
    texts = docs.select(F.col("doc_id").alias("i"), text_hash().alias("k"), F.col("text").alias("t"))
    of = near.select("x", F.col("at.i").alias("i2"), F.col("at.k").alias("k2"))
    sets = save(texts.join(of, F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2"))).select("x", "t").dropDuplicates(["x"]).mapInArrow(_sets, "x long, shingles binary"), "sets")
    alone = sets.mapInArrow(_shingles, "s long, x long").groupBy("s").agg(F.min("x").alias("x"), F.max("x").alias("y")).where("x = y").groupBy("x").agg(F.count("*").alias("alone"))
    bounded = near.join(alone, "x", "left").select("x", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))
    bounded = save(bounded.where(100 * F.col("c") >= percent * F.col("n")), "bounded")
    buckets = save(buckets.join(bounded, "x"), "members")

    t = percent / 100
    fits = (F.col("n2") <= F.col("c") * (1 + 1 / t) - F.col("n") + 1e-6) & (F.col("n") <= F.col("c2") * (1 + 1 / t) - F.col("n2") + 1e-6)
    fits &= (100 * F.col("n2") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("n2"))
    other = buckets.withColumnsRenamed({"x": "y", "n": "n2", "c": "c2"})
    centre = other.groupBy("band").agg(F.max_by(F.struct("y", "n2", "c2"), F.struct(F.col("c2") / F.col("n2"), "n2", "y")).alias("z")).select("band", "z.*")
    stars = buckets.join(centre, "band").where((F.col("x") != F.col("y")) & fits).select("x", "y").distinct()
    links = save(_links(stars, classes, sets, percent), "links")

    label = components(links)
    buckets = buckets.join(label.withColumnsRenamed({"node": "x", "root": "r"}), "x", "left").withColumn("r", F.coalesce("r", "x"))
    split = buckets.groupBy("band").agg((F.min("r") != F.max("r")).alias("split"), (F.count("*") > LARGE).alias("large")).where("split").select("band", "large")
    buckets = save(buckets.join(split, "band"), "split")
    renamed = {"x": "y", "n": "n2", "c": "c2", "r": "r2"}
    small = buckets.where("not large").drop("large")
    across = small.join(small.withColumnsRenamed(renamed), "band").where((F.col("r") < F.col("r2")) & fits).select("x", "y")
    across = across.unionByName(_across_large(buckets.where("large").drop("large"), sets, fits, renamed, t)).distinct()
    across = across.join(stars, ["x", "y"], "left_anti")
    links = save(links.unionByName(_links(across, classes, sets, percent)), "links")
    return components(links).withColumnsRenamed({"node": "x"})


def _across_large(buckets: DataFrame, sets: DataFrame, fits: Column, renamed: dict[str, str], t: float) -> DataFrame:
    """Pairs across components that may be linked, of buckets too large for all their pairs.

    Of two linked classes either both have a shingle that at most RARE classes have,
    and meet there; or their intersection is within the other shingles of each, of
    which a class has h, and the bound of step 3 holds with h in place of c.
    """
    classes = buckets.select("x", "n", "c", "r").distinct()
    shingles = save(sets.join(classes.select("x"), "x").mapInArrow(_shingles, "s long, x long"), "shingles")
    rare = shingles.join(shingles.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") <= RARE), "s")
    rare = save(rare.join(classes, "x"), "rare")
    shared = rare.where("df > 1").drop("df")
    meet = shared.join(shared.withColumnsRenamed(renamed), "s").where((F.col("r") < F.col("r2")) & fits).select("x", "y")
    few = rare.groupBy("x").agg(F.count("*").alias("few"))
    common = buckets.join(few, "x", "left").withColumn("h", F.col("n") - F.coalesce("few", F.lit(0))).drop("few")
    common = common.withColumn("room", F.col("h") * (1 + 1 / t) - F.col("n") + 1e-6)
    least = common.groupBy("band").agg(F.min("n").alias("least"))
    common = common.join(least, "band").where("least <= room").drop("least")
    mixed = common.groupBy("band").agg((F.min("r") != F.max("r")).alias("mixed")).where("mixed").select("band")
    common = save(common.join(mixed, "band"), "common")
    other = common.withColumnsRenamed({**renamed, "h": "h2", "room": "room2"})
    bound = (F.col("n2") <= F.col("room")) & (F.col("n") <= F.col("room2"))
    return meet.unionByName(common.join(other, "band").where((F.col("r") < F.col("r2")) & fits & bound).select("x", "y"))


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: i (doc_id), k (text hash), n_shingles, component_id."""
    rows = save(sketched(docs), "sketches")
    roots = class_roots(docs, rows, percent)
    classes = rows.where("n > 0").groupBy("x").agg(F.min("i").alias("least")).join(roots, "x", "left").withColumn("root", F.coalesce("root", "x"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = save(classes.join(names, "root").select("x", "component_id"), "components")
    found = rows.where("n > 0").select("i", "k", "n", "x").join(named, "x").select("i", "k", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("n = 0").select("i", "k", F.col("n").alias("n_shingles"), F.col("i").alias("component_id")))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    kept = F.coalesce(F.col("i") == F.col("component_id"), F.lit(False))
    return linked(docs, percent).select(F.col("i").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def one_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; texts without words all stay."""
    found = linked(docs, percent)
    best = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("i", "k")).alias("at")).select(F.col("at.i").alias("i2"), F.col("at.k").alias("k2"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), text_hash().alias("k"), F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    same = F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2"))
    one = rows.where("worded").join(best, same).dropDuplicates(["i", "k"]).select("row")
    return one.unionByName(rows.where("not coalesce(worded, false)").select("row")).select("row.*")
