"""Language-model scores by context-tree weighting over bytes (operator 4).

A byte is coded as eight binary decisions, each with its own tree of byte contexts
of depth 0 to ``DEPTH``.  Every node estimates its decision by Krichevsky-Trofimov
counts; a node's weighted probability is half its own and half the product of its
children's, so one pass over the counts mixes all depths.

A *string* is a byte with its DEPTH bytes of context, as an integer that has the
nearest context byte first; 0xFF, which no UTF-8 text holds, pads the start of a
text and marks its end.

1. All texts become counts of strings: in training texts, and in all texts.
2. Strings are dealt out by their ``SHARED`` nearest bytes.  All deeper nodes of such a
   context lie together, so its levels are worked out with numpy, context by context.
   One context has at most 256 ** (DEPTH - SHARED + 1) strings, however large the corpus.
3. Weights of the shared levels go up, and mixtures down, as sums and joins by parent.
4. Strings meet the mixtures of the shared levels again and get their values.  Strings
   that only held-out texts have are in the tree with count zero: such a node has
   weight one and an even estimate, which is what an unseen one amounts to.
5. A text's score is the sum of its strings' values, end included.  The most frequent
   strings, at most ``STRINGS``, are looked up in the tasks, all others by a join.

The base is a word model with counts over all training texts.  The most frequent
words, at most ``COMMON``, are looked up in the tasks, all others by a join.

Null texts are empty: their one token is the end.  A null doc_id is held out.
Repeated rows are counted and scored each.  Without training rows every estimate is
uniform.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, save, slices, strings
from tidemark.llm.hashing import mix

DEPTH = 6
#: Context bytes that the levels above the split have at most, plus one.
SHARED = 3
#: Strings that are sent to the tasks.
STRINGS = 1 << 22
COMMON = 1 << 18
#: Rows of words that a task holds before it sums them up.
WORDS = 800_000
#: Distinct strings that a task counts before it hands them on, strings sorted at a time, and strings worked on at a time.
HELD = 3_000_000
FRESH = 1 << 22
BLOCK = 1 << 17
MARK = 0xFF
#: No string: marks a free place.
FREE = np.uint64((1 << 64) - 1)
_BYTE = np.uint64(8)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The string of every byte and end, in order, and where each text's begin."""
    pad, end = bytes([MARK]) * depth, bytes([MARK])
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]), dtype=np.uint8)
    n = max(0, len(data) - depth)
    g = np.zeros(n, dtype=np.uint64)
    for k in (*range(depth - 1, -1, -1), depth):
        g <<= _BYTE
        g |= data[k : k + n]
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(size + depth) - size - depth
    keep = np.ones(n, dtype=bool)
    for k in range(depth):
        keep[(first[1:] - 1 - k)] = False
    return g[keep], np.cumsum(size) - size


def _added(g: np.ndarray, c: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts ``c`` of sorted strings ``g``, with those of other sorted strings."""
    at = np.searchsorted(g, more)
    known = at < len(g)
    known[known] = g[at[known]] == more[known]
    c[at[known]] += counts[known]
    return np.insert(g, at[~known], more[~known]), np.insert(c, at[~known], counts[~known])


def _count_grams(depth: int):
    """Counts of strings in rows (t, learn); a string's last bit says whether its text is for training."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (g, c), fresh, size = none, [], 0
        for batch in slices(batches, "t"):
            more, first = grams(strings(batch.column("t")), depth)
            learn = pc.fill_null(batch.column("learn"), False).to_numpy(zero_copy_only=False).astype(np.uint64)
            fresh.append(more << np.uint64(1) | np.repeat(learn, np.diff(np.append(first, len(more)))))
            size += len(more)
            if size >= FRESH:  # one large sort costs less than the merges that many small ones would take
                g, c = _added(g, c, *_sorted(fresh))
                fresh, size = [], 0
            if len(g) > HELD:
                yield from _gram_rows(g, c)
                g, c = none
        if fresh:
            g, c = _added(g, c, *_sorted(fresh))
        yield from _gram_rows(g, c)

    return count


def _sorted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    g = np.concatenate(parts)
    g.sort()
    heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g[heads], np.diff(np.append(heads, len(g)))


def _gram_rows(g: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of strings; the two counts of one string stand together."""
    if not len(g):
        return
    whole = g >> np.uint64(1)
    heads = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
    columns = whole[heads].view(np.int64), np.add.reduceat(c * (g & np.uint64(1)).astype(np.int64), heads), np.add.reduceat(c, heads)
    for at in range(0, len(heads), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BLOCK]) for x in columns], names=["g", "n", "c"])


#: ln of Gamma(n + 1/2) / Gamma(1/2) and of n! for small n.
_HALF = np.append(0.0, np.cumsum(np.log(np.arange(4095) + 0.5)))
_FACTORIAL = np.append(0.0, np.cumsum(np.log(np.arange(4095) + 1.0)))


def _rising(n: np.ndarray, table: np.ndarray, first: float) -> np.ndarray:
    """ln of first * (first + 1) * ... with n factors: by table, or by Stirling's series."""
    out = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    x = n[large] + first
    out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - math.lgamma(first)
    return out


def _own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _rising(a, _HALF, 0.5) + _rising(b, _HALF, 0.5) - _rising(a + b, _FACTORIAL, 1.0)


class Levels:
    """Nodes of the depths ``depth`` to ``top`` over sorted distinct strings with whole contexts of ``top`` bytes.

    A node's key is its context, nearest byte first, and a byte that holds a one and the bits decided so far.
    """

    def __init__(self, g: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.byte = (g & np.uint64(255)).astype(np.int64)
        context = g >> _BYTE << _BYTE
        key, a, b, self.node, at = [], [], [], [], 0
        for k in range(8):
            here = context | ((1 << k) | (self.byte >> (8 - k))).astype(np.uint64)
            new = np.append(True, here[1:] != here[:-1])
            heads = np.flatnonzero(new)
            one = n * ((self.byte >> (7 - k)) & 1)
            key.append(here[heads])
            b.append(np.add.reduceat(one, heads))
            a.append(np.add.reduceat(n, heads) - b[-1])
            self.node.append(np.cumsum(new) + (at - 1))
            at += len(heads)
        key, a, b = np.concatenate(key), np.concatenate(a), np.concatenate(b)
        own = _own(a, b)
        self.levels, self.parents = [(key, a, b, own, own)], []
        for _ in range(depth - top):
            key, parent = np.unique((key >> np.uint64(16) << _BYTE) | (key & np.uint64(255)), return_inverse=True)
            below = np.bincount(parent, weights=self.levels[-1][4])
            a, b = (np.bincount(parent, weights=x).astype(np.int64) for x in (a, b))
            own = _own(a, b)
            most = np.maximum(own, below)
            self.levels.append((key, a, b, own, most + np.log(0.5 * np.exp(own - most) + 0.5 * np.exp(below - most))))
            self.parents.append(parent)

    def values(self, one: np.ndarray | float, rest: np.ndarray | float) -> np.ndarray:
        """log10 chance of every string; ``one`` (chance of a one so far) and ``rest`` (weight left) by node at the top."""
        for d in range(len(self.levels) - 1, -1, -1):
            _, a, b, own, weighted = self.levels[d]
            if d < len(self.parents):
                one, rest = one[self.parents[d]], rest[self.parents[d]]
            w = np.minimum(1.0, 0.5 * np.exp(own - weighted)) if d else 1.0
            one, rest = one + rest * w * (b + 0.5) / (a + b + 1), rest * (1 - w)
        value = np.zeros(len(self.byte))
        for k, node in enumerate(self.node):
            p = one[node]
            value += np.log10(np.where((self.byte >> (7 - k)) & 1 == 1, p, 1 - p))
        return value


def _blocks(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.Table]:
    """Rows sorted by g in blocks of about ``BLOCK`` that hold whole groups of g >> shift."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("g").to_numpy() >> shift
        cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if cut and size + cut >= BLOCK:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        elif not cut and size >= BLOCK and held[-1].column("g")[-1].as_py() >> shift != group[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
        size = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _tops(depth: int):
    """Nodes of the depth ``SHARED`` from strings with whole contexts of that depth."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, 8 * (depth - SHARED + 1)):
            g, n = _columns(table, "g", "n")
            key, a, b, own, weighted = Levels(g.view(np.uint64), n, depth, SHARED).levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), a, b, own, weighted)], names=["key", "a", "b", "own", "lpw"])

    return tops


def _value_strings(depth: int):
    """Values from strings (g, n, c) and nodes of the depth ``SHARED`` (c is -1; one, rest) in one order."""
    shift = 8 * (depth - SHARED + 1)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, shift):
            g, n, c, key, one, rest = _columns(table, "g", "n", "c", "key", "one", "rest")
            string, node = c >= 0, c < 0
            order = np.argsort(key[node])
            g = g[string]
            found = Levels(g.view(np.uint64), n[string], depth, SHARED).values(one[node][order], rest[node][order])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c[string]), pa.array(found)], names=["g", "c", "value"])

    return value


def _ln_gamma(x: Column) -> Column:
    """Stirling's series after eight steps of the recurrence."""
    y = x + 8
    steps = F.lit(0.0)
    for i in range(0, 8, 2):
        steps = steps + F.ln((x + i) * (x + (i + 1)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - steps


def nodes(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Per shared level, deepest first: key, a, b (zeros, ones), own, lpw (ln weighted); ``counts``: strings g with n."""
    own = _ln_gamma(F.col("a") + 0.5) + _ln_gamma(F.col("b") + 0.5) - _ln_gamma(F.col("a") + F.col("b") + 1.0) - math.log(math.pi)
    own = F.when(F.col("a") + F.col("b") > 0, own).otherwise(0.0)
    rows = counts.select("g", "n").repartition(F.shiftright("g", 8 * (depth - SHARED + 1))).sortWithinPartitions("g")
    out = [save(rows.mapInArrow(_tops(depth), "key long, a long, b long, own double, lpw double"), "nodes")]
    for _ in range(SHARED):
        up = out[-1].groupBy(_parent().alias("key"))
        level = up.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lpw").alias("below")).withColumn("own", own)
        top = F.greatest("own", "below")
        lpw = top + F.ln(0.5 * F.exp(F.col("own") - top) + 0.5 * F.exp(F.col("below") - top))
        out.append(save(level.withColumn("lpw", lpw).drop("below"), "nodes"))
    return out


def _parent() -> Column:
    return F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))


def _mixture(levels: list[DataFrame]) -> DataFrame:
    """Per node of the depth ``SHARED``: key, one and rest, mixed over the levels above it."""
    up = None
    p, w = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1), F.least(F.lit(1.0), 0.5 * F.exp(F.col("own") - F.col("lpw")))
    for level in reversed(levels):
        here = level.select("key", _parent().alias("parent"), p.alias("p"), w.alias("w"))
        if up is None:
            here = here.select("key", F.lit(0.0).alias("above"), F.lit(1.0).alias("left"), "p", "w")
        else:
            here = here.join(up.withColumnRenamed("key", "parent"), "parent").select("key", F.col("one").alias("above"), F.col("rest").alias("left"), "p", "w")
        up = here.select("key", (F.col("above") + F.col("left") * F.col("w") * F.col("p")).alias("one"), (F.col("left") * (1 - F.col("w"))).alias("rest"))
    return here.select("key", F.col("above").alias("one"), F.col("left").alias("rest"))


class Model:
    """log10 chances of strings in a table of ``places`` (a power of two, more than its strings), with linear probing.

    Values are held in 32 bits, which moves a text's score by less than a part in ten million.
    """

    def __init__(self, places: int):
        self.places = places
        self.known = np.full(places, FREE, dtype=np.uint64)
        self.value = np.zeros(places, dtype=np.float32)

    def _place(self, g: np.ndarray) -> np.ndarray:
        return (mix(g) & np.uint64(self.places - 1)).astype(np.int64)

    def fill(self, g: np.ndarray, value: np.ndarray) -> None:
        """Put in strings that differ from each other and from those in the table."""
        at = self._place(g)
        while len(g):
            free = self.known[at] == FREE
            self.known[at[free]] = g[free]
            lost = self.known[at] != g
            self.value[at[~lost]] = value[~lost]
            g, value, at = g[lost], value[lost], (at[lost] + 1) & (self.places - 1)

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 chance of the last byte of each string after the others; NaN if it is not in the table."""
        at = self._place(g)
        known = self.known[at]
        out = np.where(known == g, self.value[at].astype(np.float64), np.nan)
        left = np.flatnonzero((known != g) & (known != FREE))
        at = at[left]
        while len(left):
            at = (at + 1) & (self.places - 1)
            known = self.known[at]
            hit = known == g[left]
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (known != FREE)
            left, at = left[on], at[on]
        return out


def valued(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Every string of the column ``t``: g, c (occurrences), value (log10 chance after training on rows with ``learn``)."""
    count = few_rows(texts.select("t", "learn")).mapInArrow(_count_grams(depth), "g long, n long, c long")
    # the tasks have summed their own counts, so rows go to their sums at once
    found = save(count.repartition("g").groupBy("g").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "grams")
    shift = 8 * (depth - SHARED + 1)
    tops = _mixture(nodes(found, depth)).select(
        F.shiftleft(F.shiftright("key", 8), shift).alias("g"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("c"), "key", "one", "rest"
    )
    rows = found.select("g", "n", "c", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("one"), F.lit(0.0).alias("rest")).unionByName(tops)
    rows = rows.repartition(F.shiftright("g", shift)).sortWithinPartitions("g", "c")
    return save(rows.mapInArrow(_value_strings(depth), "g long, c long, value double"), "values")


def at_least(rows: DataFrame, most: int) -> Column:
    """Condition on a count ``c`` that at most ``most`` rows meet, found from a histogram of counts."""
    step = F.floor(F.log2("c") * 16)
    bins = sorted((r.step, r.n) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())
    total, least = 0, None
    for at, n in reversed(bins):
        total += n
        if total > most:
            break
        least = at
    return step >= least if least is not None else F.lit(False)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().tobytes()], pa.binary()) for c in ("g", "value")], names=["g", "value"])


def table_of(values: DataFrame) -> Model:
    """Table of strings brought to the driver part by part, packed, each put in as it comes."""
    model = Model(1 << (2 * values.count()).bit_length())
    for r in values.select("g", "value").mapInArrow(_packed, "g binary, value binary").toLocalIterator():
        model.fill(np.frombuffer(r.g, np.uint64), np.frombuffer(r.value, np.float64))
    return model


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of all texts in order, A-Z lower-cased, each with the place of its text."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    text, word = pc.list_parent_indices(found), pc.list_flatten(found)
    some = pc.greater(pc.binary_length(word), 0)  # spaces at an end of a text leave an empty word
    return text.filter(some).to_numpy(zero_copy_only=False).astype(np.int64), word.filter(some).cast(pa.binary()).dictionary_encode()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "t", 1 << 22):
        word = _words(batch.column("t"))[1]
        held.append(pa.RecordBatch.from_arrays([word.dictionary, pa.array(np.bincount(word.indices.to_numpy(zero_copy_only=False), minlength=len(word.dictionary)))], names=["word", "c"]))
        size += len(word.dictionary)
        if size > WORDS:
            held = _summed(held)
            size = sum(x.num_rows for x in held)
            if size > WORDS // 2:
                yield from held
                held, size = [], 0
    yield from _summed(held)


def _summed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not parts:
        return []
    return pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches()


def _rare_words(text: np.ndarray, code: np.ndarray, word: pa.Array, texts: int) -> pa.ListArray:
    """Per text those words, by their place among the distinct ones, each with its count."""
    pair, n = np.unique(text * max(1, len(word)) + code, return_counts=True)
    text, code = pair // max(1, len(word)), pair % max(1, len(word))
    rows = pa.StructArray.from_arrays([word.take(pa.array(code)), pa.array(n)], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts + 1)), pa.int32()), rows)


def _rare_strings(g: np.ndarray, first: np.ndarray, rare: np.ndarray) -> pa.ListArray:
    """Per text the strings at the places ``rare``, each with its count."""
    text = np.searchsorted(first, rare, side="right") - 1
    order = np.lexsort((g[rare], text))
    text, g = text[order], g[rare][order]
    start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (text[1:] != text[:-1]))) if len(g) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(g)))
    offsets = np.searchsorted(text[start], np.arange(len(first) + 1))
    rows = pa.StructArray.from_arrays([pa.array(g[start].view(np.int64)), pa.array(n)], ["g", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def scored(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, strings_sent: int = STRINGS, common: int = COMMON) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("i"), held_out.alias("held_out"), F.col("text").alias("t"))
    learn = F.coalesce(~F.col("held_out"), F.lit(False))
    words = save(few_rows(rows.where(learn).select("t")).mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = rows.where(learn).count()
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    below = math.log10(tokens + 0.5 * (distinct + 1))
    sent_words = at_least(words, common)
    top = words.where(sent_words).select("word", "c").toArrow()
    value = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), (math.log10(c + 0.5) for c in top.column("c").to_pylist()))))
    values = valued(rows.select("t", learn.alias("learn")), depth)
    sent = at_least(values, strings_sent)
    model = spark.sparkContext.broadcast(table_of(values.where(sent)))
    end_value = math.log10(ends + 0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, table = value.value.get, model.value
        for batch in slices(batches, "t", 1 << 19):
            texts = strings(batch.column("t"))
            text, word = _words(batch.column("t"))
            code = word.indices.to_numpy(zero_copy_only=False)
            found = np.fromiter(map(get, word.dictionary.to_pylist(), repeat(math.nan)), dtype=np.float64, count=len(word.dictionary))[code]
            other = np.isnan(found)
            found[other] = 0
            n = np.bincount(text, minlength=len(texts)) + 1
            known = n - np.bincount(text[other], minlength=len(texts)) - (ends == 0)
            base = np.bincount(text, weights=found, minlength=len(texts)) + end_value - below * n
            rare = _rare_words(text[other], code[other], word.dictionary, len(texts))
            g, first_of = grams(texts, depth)
            chance = table.log10(g)
            missing = np.isnan(chance)
            chance[missing] = 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("i", "row", "held_out")), *(pa.array(x, pa.int64()) for x in (n, known, [len(t) for t in texts])), pa.array(base), pa.array(np.add.reduceat(chance, first_of)), rare, _rare_strings(g, first_of, np.flatnonzero(missing))],
                names=["i", "row", "held_out", "n_tokens", "n_top", "n_bytes", "base_top", "score_top", "rare", "strings"],
            )

    first = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, f"i {kind}, row long, held_out boolean, n_tokens long, n_top long, n_bytes long, base_top double, score_top double, rare array<struct<word:binary,n:long>>, strings array<struct<g:long,n:long>>")
    first = save(first, "scores")  # row numbers hold from here on
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(words.where(~sent_words), "word", "left")
    rare = rare.select("row", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base"), F.when(F.col("c") > 0, F.col("n")).alias("n"), F.lit(0.0).alias("score"))
    less = first.select("row", F.explode("strings").alias("r")).select("row", "r.g", "r.n").join(values.where(~sent).select("g", "value"), "g")
    less = less.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("value")).alias("score"))
    rare = rare.unionByName(less).groupBy("row").agg(F.sum("base").alias("base_rare"), F.sum("n").alias("n_rare"), F.sum("score").alias("score_rare"))
    scores = first.drop("rare", "strings").join(rare, "row", "left").withColumn("score", F.col("score_top") + F.coalesce("score_rare", F.lit(0.0)))
    return scores.select(
        F.col("i").alias("doc_id"), "held_out", "n_tokens", (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
