import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import components_by_brute_force

import __spark_entry__
import corpus_pipeline
from tidemark.llm import context_tree, decontaminate, hard_negatives, license_scan, merkle, near_dedup, packing, quality, toxicity

GIVEN = "/root/testdata/sf0.01"
CLASHING = ("t", "k", "i", "i2", "k2", "h", "n", "x", "w", "row", "size", "score", "label", "piece", "words", "ids", "item", "sizes", "s", "v", "q", "held_out", "n_words", "key")


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert [k for k in range(1, 14) if not any(n.startswith(f"op{k}_") for n in names)] == []
    assert "pipeline" in names and not __spark_entry__.oracle_sql().keys() - names.keys()


@pytest.fixture
def operators(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "")], "item_id long, text string")
    return {
        "op1": lambda d: toxicity.scored(d, labels),
        "op2": lambda d: decontaminate.contained(d, benchmark),
        "op4": context_tree.scored,
        "op5": quality.judged,
        "op8": license_scan.scanned,
        "op10": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
        "op11": merkle.audited,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op8", "op10", "op11"])
def test_clashing_columns_repeated_rows_nulls_and_no_rows(docs_of, words, operators, name):
    run = operators[name]
    same = words(40)
    texts = [(1, same), (1, same), (None, same), (None, None), (5, None), (6, ""), (7, "alpha beta gamma delta epsilon zeta mit license"), (8, words(300)), (9, "ü" * 50 + " MIT License. " + words(20))]
    docs = docs_of(texts)
    more = docs
    for c in CLASHING:
        more = more.withColumn(c, F.lit(c))
    key = lambda rows, columns: sorted(str([r[c] for c in columns]) for r in rows)
    plain = run(docs)
    columns = [c for c in plain.columns if c not in ("sequence_id", "offset")]  # any numbers do for these
    got = plain.collect()
    assert key(got, columns) == key(run(more).collect(), columns)
    assert len(got) >= len(texts) or name == "op2"
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op4", "op8", "op10"])
def test_a_text_of_megabytes(docs_of, words, operators, name):
    rng = random.Random(2)
    pool = words(3000).split()
    long = " ".join(rng.choices(pool, k=300_000)) + " mit license"
    docs = docs_of([long, words(50), words(30)])
    got = operators[name](docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2}
    if name == "op8":
        assert next(r for r in got if r.doc_id == 0).n_words == 300_002
    if name == "op10":
        pieces = sorted((r.start, r.length) for r in got if r.doc_id == 0)
        assert [a for a, _ in pieces[1:]] == [a + n for a, n in pieces[:-1]] and all(n <= 2048 for _, n in pieces)


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="needs the given tables")
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stages_without_rows(spark, stage):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").limit(0)
    found = stage[1](spark, docs, GIVEN)
    assert found.count() == 0
    assert stage[0] == "packed" or found.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="needs the given tables")
def test_near_duplicates_of_a_given_table(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(docs).collect()}
    assert got == {i: (n, i if n == 0 else c) for i, n, c in components_by_brute_force(rows)}
    assert len({c for _, c in got.values()}) < len(rows)


def test_blocks_hold_few_rows(spark):
    """Constants that bound what one task holds."""
    assert hard_negatives.BLOCK * 64 * 4 < 1 << 20 and hard_negatives.ANCHORS * 8 * 256 * 8 < 1 << 23 and 1 << merkle.STEP <= 1 << 10
