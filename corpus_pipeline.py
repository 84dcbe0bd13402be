"""Corpus pipeline: quality, deduplication, decontamination and packing of documents.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their
columns; the last one returns the packed pieces.  Stages are written as Parquet and
read again, so a lost executor repeats a stage's work and not the pipeline's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from tidemark.llm.common import read, save


#: Passages of over 50 words have 285 bytes and more; the 400 bytes of the query op3 alone would miss most of them.
REPEATED_BYTES = 280


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8) stays, the one of the smallest doc_id."""
    return near_dedup.one_each(docs, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEATED_BYTES`` that also start elsewhere are cut out; n_chars follows the text."""
    cut = suffix_dedup.strip(docs, length=REPEATED_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("without_benchmark", without_benchmark),
    ("packed", packed),
]

#: Compression ratios and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
