import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives

KIND = "vec_id long, embedding array<float>, label int"


def by_brute_force(rows, positives=5, negatives=3):
    live = [(k, v, [math.floor(256 * float(np.float32(x))) for x in e], lab) for k, (v, e, lab) in enumerate(rows) if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []

    def first(found, count):
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:count]

    for k, v, q, lab in live:
        if v is None or v % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, e)), w, j, other) for j, w, e, other in live if j != k]
        for s, w, _, _ in first([x for x in scored if x[3] == lab], positives):
            fits = [x for x in scored if x[3] != lab and 50 * s <= 100 * x[0] <= 95 * s]
            out += [(v, w, r, x[1], s, x[0]) for r, x in enumerate(first(fits, negatives), 1)]
    return out


def table(seed, n, dims, labels, ids=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0.2, 0.5) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for k in range(n):
        lab = rng.randrange(labels)
        rows.append((k if ids is None else rng.randrange(ids), [float(np.float32(c + rng.gauss(0, 0.4))) for c in centres[rng.choice([lab, 0])]], lab))
    return rows


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("block, anchors, chunk, rows", [
    (2048, 256, 512, table(1, 900, 12, 4)),
    (16, 2, 7, table(2, 400, 64, 3)),
    (8, 4, 5, table(3, 300, 3, 2, ids=100)),
    (2048, 256, 512, [(k, [0.5, -0.25] if k % 3 else [0.0, 0.0], k % 2) for k in range(210)]),
])
def test_mined_as_brute_force(spark, monkeypatch, block, anchors, chunk, rows):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    vectors = spark.createDataFrame(rows, KIND).repartition(3)
    for name in ("rid", "no", "q", "anchor", "pair", "kind", "rank", "score"):
        vectors = vectors.withColumn(name, F.lit(name))
    got = hard_negatives.mined(vectors, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_brute_force(rows), key=key)
    assert got


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(50, None, 1), (1, [1.0, None], 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 2), (4, [1.0, 1.0], None), (None, [0.7, 0.6], 2), (None, [1.0, 1.0], 1), (100, [], 1), (5, [3.0, -1.0, 2.0, 0.5], 2), (6, [1.5], 1)]
    rows = [*odd, *table(5, 60, 2, 2), *table(5, 60, 2, 2)[:30]]
    got = hard_negatives.mined(spark.createDataFrame(rows, KIND), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_brute_force(rows), key=key)


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], KIND)
    assert hard_negatives.mined(empty, F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives.mined(spark.createDataFrame(table(1, 20, 4, 2), KIND), F.lit(False)).collect() == []
    with pytest.raises(ValueError, match="can't be scored"):
        hard_negatives.mined(spark.createDataFrame([(0, [1e9], 1)], KIND), F.lit(True))


def test_scores_are_inner_products():
    rng = np.random.default_rng(2)
    a, c = rng.integers(-300, 300, (9, 24)), rng.integers(-512, 512, (1300, 24))
    packed = hard_negatives.pack_planes(c, 10)
    assert packed.shape == (1300, 10, 3)
    for kind in (np.int32, np.int64):
        assert (hard_negatives.scores(hard_negatives.subset_sums(a).astype(kind), packed) == c @ a.T).all()
