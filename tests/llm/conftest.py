import random

import pytest

NEW = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """documents with the given texts (a text, or a pair of doc_id and text)."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(k, t, None, "s", None) for k, t in rows], NEW)

    return make


@pytest.fixture
def words():
    """Reproducible texts of made-up words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(4000)]
    return lambda n: " ".join(rng.choices(vocabulary, k=n))
