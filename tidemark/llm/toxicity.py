"""Toxicity by multiple-instance learning over sentences (operator 1).

Only documents are labelled.  A sentence's score is a logistic function of its
words and their beginnings; a document's is the noisy-or of its sentences, 1 - prod(1 - p).  The weights
are trained from the document labels through that noisy-or, so that afterwards the
sentences with a high score are the offending ones.

The classifier is fitted on at most ``SAMPLE_DOCS`` labelled rows and ``SAMPLE_BYTES``
of their text, the first by a hash of doc_id, none of over ``SAMPLE_TEXT_BYTES``; scoring covers every row.  Where a
doc_id has several labels the highest counts; rows without a label, or with a null
one, are not learned from.

Null and empty texts have no sentence and a score of 0.  A null doc_id is held out.
Repeated rows are scored each.  Without labelled rows of both kinds nothing is
learned and every score is that of the bias.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, slices, strings, text_hash

SAMPLE_DOCS = 8000
SAMPLE_BYTES = 32 << 20
#: A longer text is left out of the sample, so that it doesn't take the place of many.
SAMPLE_TEXT_BYTES = SAMPLE_BYTES // 8
#: A word needs so many documents of the sample to have a weight.
MIN_DOCS = 4
#: Byte lengths of the beginnings of words that are features beside the words.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A feature needs so many times the toxic share of all documents to have a weight.
LIFT = 1.5
#: Words whose weights a task remembers.
REMEMBERED = 400_000
STEPS = 160
RATE = 0.15
L1 = 2e-4
BIAS = -6.0
PREDICT = 0.7
OFFENDING = 0.5
_END = re.compile(rb"[.!?\n]+")
#: Letters lower-cased, digits and non-ASCII kept, all else a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that are not blank."""
    edges, at = [], 0
    for m in _END.finditer(text):
        edges.append((at, m.end()))
        at = m.end()
    edges.append((at, len(text)))
    return [(a, b) for a, b in edges if text[a:b].strip()]


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings as ``beginning-``: stems take endings."""
    return [word, *(word[:k] + b"-" for k in PREFIXES if k < len(word))]


def loss_and_slopes(w: np.ndarray, b: float, word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Mean log loss of noisy-or document scores, and its slopes by weights and bias.

    ``word`` and ``sentence`` list the features of sentences, ``doc`` the document of each sentence, ``y`` the labels.
    """
    n = len(y)
    z = b + np.bincount(sentence, weights=w[word], minlength=len(doc))
    p = 1 / (1 + np.exp(-z))
    none = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=n)  # ln of "no sentence is toxic"
    some = np.maximum(-np.expm1(none), 1e-9)
    loss = -np.where(y == 1, np.log(some), none).mean()
    pull = np.where(y == 1, -np.exp(none) / some, 1.0)  # slope of the loss by ln(1 - p), times -1
    g = pull[doc] * p / n
    return float(loss), np.bincount(word, weights=g[sentence], minlength=len(w)), float(g.sum())


def fit(texts: list[bytes], toxic: np.ndarray) -> tuple[float, dict[bytes, float]]:
    """Bias and feature weights by proximal gradient steps (Adam) on the document loss."""
    per: list[list[bytes]] = []
    doc_of: list[int] = []
    count: dict[bytes, int] = {}
    bad: dict[bytes, int] = {}
    for k, t in enumerate(texts):
        seen: set[bytes] = set()
        for a, b in sentences(t):
            words = list(set(t[a:b].translate(_WORDS).split()))
            per.append(words)
            doc_of.append(k)
            seen.update(words)
        for f in {f for w in seen for f in features(w)}:
            count[f] = count.get(f, 0) + 1
            if toxic[k]:
                bad[f] = bad.get(f, 0) + 1
    if len(set(toxic.tolist())) < 2:
        return BIAS, {}
    # a noisy-or needs no evidence against, so only features of toxic documents get a weight
    share = LIFT * toxic.mean()
    ids = {f: i for i, f in enumerate(sorted(f for f, n in bad.items() if count[f] >= MIN_DOCS and n > share * count[f]))}
    known: dict[bytes, list[int]] = {}
    for words in per:
        for w in words:
            if w not in known:
                known[w] = [ids[f] for f in features(w) if f in ids]
    found = [[i for w in words for i in known[w]] for words in per]
    sentence = np.repeat(np.arange(len(found)), [len(x) for x in found])
    word = np.array([i for x in found for i in x], dtype=np.int64)
    doc = np.array(doc_of)
    w, b = np.zeros(len(ids)), BIAS
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    y = toxic.astype(float)
    for step in range(1, STEPS + 1):
        _, gw, gb = loss_and_slopes(w, b, word, sentence, doc, y)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**step, 1 - 0.999**step
        scale = RATE / (np.sqrt(v / d) + 1e-6)
        w = w - scale * m / c
        w = np.sign(w) * np.maximum(np.abs(w) - scale * L1, 0)
        b -= RATE * (mb / c) / (np.sqrt(vb / d) + 1e-6)
    return float(b), {k: float(w[i]) for k, i in ids.items() if abs(w[i]) > 1e-3}


class Weigher:
    """Sum of a word's feature weights, remembered for words met before."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights, self.known = weights, {}

    def __call__(self, words: set[bytes]) -> float:
        known, total = self.known, 0.0
        for w in words:
            x = known.get(w)
            if x is None:
                if len(known) > REMEMBERED:
                    known.clear()
                x = known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            total += x
        return total


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """t, toxic of the bounded sample of labelled rows that may be learned from; texts over ``SAMPLE_TEXT_BYTES`` are only scored."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spark, kinds = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id", text_hash().alias("k"), size.alias("size")).where(F.col("size") <= SAMPLE_TEXT_BYTES).dropDuplicates(["doc_id", "k"]).join(known, "doc_id")
    # keys of the sample only: at most SAMPLE_DOCS rows, whose texts are then looked up without a shuffle
    first = rows.orderBy(F.xxhash64("doc_id"), "k").limit(SAMPLE_DOCS).collect()
    total = np.cumsum([r["size"] for r in first])
    chosen = [(r.doc_id, r.k, int(r.toxic)) for r, n in zip(first, total) if n <= SAMPLE_BYTES]
    keys = spark.createDataFrame(chosen, f"i {kinds}, k2 long, toxic long")
    texts = docs.select("doc_id", text_hash().alias("k"), F.col("text").alias("t")).join(F.broadcast(keys), (F.col("doc_id") == F.col("i")) & (F.col("k") == F.col("k2")))
    return texts.dropDuplicates(["doc_id", "k"]).orderBy(F.xxhash64("doc_id"), "k").select("t", "toxic")


def scored(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_sentences, offending (byte spans and scores)."""
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    learned = sample(docs, labels, ~held_out)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += strings(batch.column("t"))
            toxic += batch.column("toxic").to_pylist()
        bias, weights = fit(texts, np.array(toxic, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *weights], pa.binary()), pa.array([bias, *weights.values()], pa.float64())], names=["word", "weight"])

    # the sample is bounded, and so are its words
    table = learned.coalesce(1).mapInArrow(learn, "word binary, weight double").toArrow()
    weights = dict(zip(table.column("word").to_pylist(), table.column("weight").to_pylist()))
    bias = weights.pop(b"", BIAS)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(shared.value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, "t"):
            total, count, bad = [], [], []
            for text in strings(batch.column("t")):
                at = sentences(text)
                low = text.translate(_WORDS)
                z = np.array([bias + weigh(set(low[a:b].split())) for a, b in at])
                none = float(-np.logaddexp(0, z).sum()) if len(z) else 0.0
                total.append(float(-np.expm1(none)))
                count.append(len(at))
                bad.append([{"start": at[k][0], "end": at[k][1], "score": float(1 / (1 + np.exp(-z[k])))} for k in np.flatnonzero(z > np.log(OFFENDING / (1 - OFFENDING))).tolist()])
            values = np.array(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= PREDICT).astype(np.int32)), pa.array(count, pa.int64()), pa.array(bad, span)],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").alias("t"))
    return few_rows(rows).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,score:double>>")
