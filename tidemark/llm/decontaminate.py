"""Benchmark decontamination: short items inside long documents (operator 2, native).

A document is far larger than an item, so their similarity says nothing and the
search goes by containment: an item is found where at least ``percent`` of its
distinct five-word shingles occur in the document.

1. Items are partitioned by size.  A class of items of up to u shingles keeps the
   k = u - ceil(t u) + 1 smallest hashes of each item as its MinHash sketch.  A
   document that holds a share t of the item's shingles misses at most k - 1 of
   them, so it holds one of the sketch: the search loses nothing, in any class.
2. Document shingles above the largest hash of all sketches are dropped as they
   are made; the others are looked up in the sketches.
3. Candidates are pairs of a document and an item and are verified as such: the
   item's shingles are looked for among those of the document, as texts, and counted.

Only DataFrame functions run.  The sketches are broadcast while they have at most
``BROADCAST_ROWS`` rows and joined by shuffle beyond that.

A-Z is lower-cased; words are runs of anything but space and \\x09-\\x0D.  Items
with fewer words than a shingle have their whole sequence as one shingle, matched
with whole documents of those words.  Null and empty items are found nowhere; null
documents hold nothing.  Repeated rows of a document are reported once, items with
one item_id and different texts each for itself.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, text_hash

PERCENT = 80
WORDS = 5
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str):
    """Array of words; a text without any has none."""
    return F.expr(f"filter(split(translate({text}, '{_UPPER}', '{_LOWER}'), '[ \\\\x09-\\\\x0D]+', -1), w -> w <> '')")


def _shingles(words: str, make: str) -> str:
    """SQL for an array over all shingles of ``words``; ``make`` gives one from its words at i."""
    whole = make.format(f"slice({words}, 1, {WORDS})")
    part = make.format(f"slice({words}, i, {WORDS})")
    return f"CASE WHEN size({words}) = 0 THEN array() WHEN size({words}) < {WORDS} THEN array({whole}) ELSE transform(sequence(1, size({words}) - {WORDS - 1}), i -> {part}) END"


_TEXT = "array_join({}, ' ')"


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, v (hash of the text), item (a number), q (distinct shingles), s (shingle), h (its hash)."""
    rows = items.select("item_id", text_hash().alias("v"), _words("text").alias("w")).dropDuplicates(["item_id", "v"])
    rows = rows.select("item_id", "v", F.monotonically_increasing_id().alias("item"), F.expr(f"array_distinct({_shingles('w', _TEXT)})").alias("all"))
    return rows.select("item_id", "v", "item", F.size("all").cast("long").alias("q"), F.explode("all").alias("s")).withColumn("h", F.xxhash64("s"))


def size_class():
    """The partition of an item of q shingles: its upper bound is 2 ** size."""
    return F.ceil(F.log2(F.col("q"))).cast("int")


def sketch_size(percent: int):
    """Hashes kept for an item of a partition."""
    u = F.pow(F.lit(2), F.col("size"))
    return (F.floor(u * (100 - percent) / 100) + 1).cast("long")


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs with enough of an item: doc_id, item_id, n_item, n_shared, containment (and k, v: text hashes)."""
    shingles = save(item_shingles(items).withColumn("size", size_class()), "items")
    ranked = shingles.groupBy("size", "item").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    sketch = save(ranked.select("item", F.explode(F.slice("hs", F.lit(1), sketch_size(percent).cast("int"))).alias("h")), "sketch")
    rows, top = sketch.agg(F.count("*"), F.coalesce(F.max("h"), F.lit(-(1 << 63)))).first()
    small = rows <= BROADCAST_ROWS

    texts = docs.select(F.col("doc_id"), text_hash().alias("k"), "text")
    hashed = F.expr(f"filter({_shingles('w', 'xxhash64(' + _TEXT + ')')}, h -> h <= {top}L)" if top > -(1 << 63) else "cast(array() as array<bigint>)")
    looked = texts.select("doc_id", "k", _words("text").alias("w")).select("doc_id", "k", F.explode(hashed).alias("h"))
    hits = looked.join(F.broadcast(sketch) if small else sketch, "h")
    candidates = save(hits.select("doc_id", "k", "item").distinct(), "candidates")

    # only shingles that some item has go on, each once for a document however many items share it
    known = shingles.select("s").distinct()
    known = F.broadcast(known) if shingles.count() <= BROADCAST_ROWS else known
    same = texts["doc_id"].eqNullSafe(F.col("i2")) & (texts["k"] == F.col("k2"))
    found = texts.join(candidates.select(F.col("doc_id").alias("i2"), F.col("k").alias("k2")).distinct(), same, "left_semi").dropDuplicates(["doc_id", "k"])
    parts = found.select("doc_id", "k", _words("text").alias("w")).select("doc_id", "k", F.explode(F.expr(f"array_distinct({_shingles('w', _TEXT)})")).alias("s")).join(known, "s", "left_semi")
    # a candidate asks for its own item's shingles and no other's
    asked = candidates.withColumnsRenamed({"doc_id": "i2", "k": "k2"}).join(shingles.select("item_id", "v", "item", "q", F.col("s").alias("s2")), "item")
    shared = parts.join(asked, F.col("doc_id").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")) & (F.col("s") == F.col("s2")))
    counts = shared.groupBy("doc_id", "k", "item_id", "v", "q").agg(F.count("*").alias("n_shared"))
    return counts.where(F.col("n_shared") * 100 >= F.col("q") * percent).select(
        "doc_id", "item_id", F.col("q").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"), "k", "v"
    )


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = contained(docs, items, percent).select(F.col("doc_id").alias("i2"), F.col("k").alias("k2")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), text_hash().alias("k"))
    return rows.join(bad, F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")), "left_anti").select("row.*")
