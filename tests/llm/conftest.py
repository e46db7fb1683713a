import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and repeated rows, clashing extra columns, one long text."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 10, 7, "k"),
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 10, 7, "k"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, 1, ""),
        (None, "one text without an id", "en", None, 3, 1, "x"),
        (None, None, None, None, None, None, None),
        (4, "12 34 !! ??", "de", "b", 5, 2, "y"),
        (5, "wort " * 40_000, "de", "b", 200_000, 2, "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
