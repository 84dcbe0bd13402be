import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def way(levels, r):
    return [(r >> k & 1, level[(r >> k) ^ 1] if (r >> k) ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


def fold(h, path):
    for left, sibling in path:
        h = digest(h) if sibling is None else digest(sibling, h) if left else digest(h, sibling)
    return h


def by_brute_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for q, g in enumerate(names):
        for r, (_, _, h, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], r) + way(top, q)
            i, source, lang, n, text = row
            bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            root = fold(leaf(i, source, lang, n + 1, text) if bad else h, path)
            out.append((i, h, trees[g][-1][0], top[-1][0], digest(*(s for _, s in path if s)), root, root == top[-1][0]))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(sizes):
    rng = random.Random(7)
    rows = []
    for lang, n in sizes.items():
        for k in range(n):
            rows.append((rng.randrange(10**6), rng.choice(["a", "é", None]), lang, rng.choice([None, k, -k]), rng.choice([None, "", "x:1", "ünï" * k])))
    return rows


@pytest.mark.parametrize("step, sizes", [(8, {"en": 300, "de": 1, None: 2, "": 3}), (2, {"en": 65, "fr": 64, "ß": 17, "z": 16, None: 1, "𝄞": 5, "￿": 4}), (1, {None: 9}), (3, {"en": 1})])
def test_proofs_as_brute_force(spark, monkeypatch, step, sizes):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = rows_of(sizes)
    rows += rows[:2] * 3 + [(None, None, None, None, None)] * 2 if len(rows) > 1 else []
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("g", "h", "r", "key", "path", "size", "seen", "leaf", "root", "name"):
        docs = docs.withColumn(name, F.lit(name))
    got = merkle.audited(docs).collect()
    want = by_brute_force(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(not r.verified for r in got) or len(rows) == 1


def test_no_rows(spark):
    assert merkle.audited(spark.createDataFrame([], DOCS)).collect() == []


def test_only_every_few_levels_are_written(spark):
    nodes = spark.range(1000).select(F.lit("x").alias("g"), F.lit(1000).cast("long").alias("size"), F.col("id").alias("r"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    blocks, root = merkle.written(nodes)
    assert [b.agg(F.sum(F.size("members"))).first()[0] for b in blocks] == [1000, 4]
    assert root.collect()[0].h == tree([hashlib.sha256(str(k).encode()).hexdigest() for k in range(1000)])[-1][0]
