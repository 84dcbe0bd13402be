import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan, toxicity


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    sentences, features, docs = 60, 15, 20
    doc = np.sort(np.concatenate([np.arange(docs), rng.integers(0, docs, sentences - docs)]))
    sentence = np.sort(rng.integers(0, sentences, 200))
    word = rng.integers(0, features, 200)
    y = (rng.random(docs) < 0.4).astype(float)
    w, b = rng.normal(0, 1, features), -1.3

    def loss(w, b):
        total = 0.0
        for d in range(docs):
            none = 1.0
            for s in np.flatnonzero(doc == d):
                z = b + sum(w[f] for f, at in zip(word, sentence) if at == s)
                none *= 1 - 1 / (1 + math.exp(-z))
            total -= math.log(1 - none if y[d] else none)
        return total / docs

    value, gw, gb = toxicity.loss_and_slopes(w, b, word, sentence, doc, y)
    assert value == pytest.approx(loss(w, b), abs=1e-9)
    e = 1e-5
    for f in range(features):
        step = np.zeros(features)
        step[f] = e
        assert gw[f] == pytest.approx((loss(w + step, b) - loss(w - step, b)) / (2 * e), abs=1e-6)
    assert gb == pytest.approx((loss(w, b + e) - loss(w, b - e)) / (2 * e), abs=1e-6)


def corpus(words):
    rng = random.Random(4)
    vile = ["zorkish", "grubbler", "slimeful", "vexhound"]
    texts, labels = [], []
    for k in range(240):
        lines = [words(rng.randint(4, 9)) for _ in range(rng.randint(1, 5))]
        bad = k % 3 == 0
        if bad:
            at = rng.randrange(len(lines))
            lines[at] = f"{lines[at]} {rng.choice(vile)} {rng.choice(vile)}"
        texts.append(". ".join(lines) + ".")
        labels.append((k, 1, int(bad)))
    return texts, labels


def test_scores_as_brute_force(spark, docs_of, words):
    """The noisy-or of the fitted weights, worked out sentence by sentence in plain Python."""
    texts, labels = corpus(words)
    texts += [None, "", "  \n ", "grubbler " * 3000 + ". plain words here."]
    docs = docs_of(texts)
    for name in ("t", "k", "i", "toxic", "score", "size"):
        docs = docs.withColumn(name, F.lit(name))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    learned = toxicity.sample(docs, table, F.col("doc_id") % 2 == 0).collect()
    bias, weights = toxicity.fit([r.t.encode() for r in learned], np.array([r.toxic for r in learned]))
    got = {r.doc_id: r for r in toxicity.scored(docs, table, F.col("doc_id") % 2 == 1).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        none = 1.0
        for a, b in toxicity.sentences(raw):
            z = bias
            for w in set(raw[a:b].translate(toxicity._WORDS).split()):
                z += sum(weights.get(f, 0.0) for f in toxicity.features(w))
            none *= 1 / (1 + math.exp(z))
        assert got[k].score == pytest.approx(1 - none, abs=1e-9)
        assert got[k].predicted == int(got[k].score >= 0.7) and got[k].held_out == (k % 2 == 1)
    held = [k for k, _, bad in labels if k % 2]
    assert sum((got[k].predicted == 1) == bool(labels[k][2]) for k in held) > 0.9 * len(held)
    for k in held:
        if labels[k][2] and got[k].predicted:  # the sentence with the words is the one that is named
            raw = texts[k].encode()
            assert any(re.search(rb"zorkish|grubbler|slimeful|vexhound", raw[o.start : o.end]) for o in got[k].offending)


def test_no_rows_no_labels(spark, docs_of, words):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs_of([]), labels).count() == 0
    got = toxicity.scored(docs_of([words(9), None]), labels).collect()
    assert [0 <= r.score <= 1 for r in got] == [True, True]


def test_every_licence_and_its_modified_copies(words):
    """Each template is found whole, without every twelfth word, and within other words; other texts have no label."""
    scan = license_scan.Scanner().scan
    assert len(license_scan.TEMPLATES) >= 40
    for label, text in license_scan.TEMPLATES.items():
        whole = f"{words(12)} {text} {words(12)}".encode()
        assert (label, 1.0) in {x[:2] for x in scan(whole)[2]}, label
        parts = text.split()
        if len(license_scan.words_of(text.encode())) >= 30:
            less = " ".join(w for k, w in enumerate(parts) if k % 12 != 7)
            assert label in {x[0] for x in scan(f"{words(12)} {less} {words(12)}".encode())[2]}, label
    assert scan(words(4000).encode())[2] == []
