import os

import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, text_key string, row_key string, n int, stratum int, label string"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are absent")
    return SMALL


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    filler = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"l{i % 997}x{i % 31}" for i in range(30_000))
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, filler, "en", None), (4, filler, "en", None),
        (5, filler + " end", "en", "b"), (6, filler.upper(), None, "b"), (7, long, "de", "a"), (8, "x" * 50_000, "de", "a"),
        (9, "one two", "en", "c"), (10, "ONE\ttwo", "en", "c"), (11, "one two three", "en", "c"), (None, filler, "en", "a"), (None, None, None, None),
        (4, "another text under the same id " + filler[::-1], "en", "a"), (12, "tie\ntie\ntie\nline of many sites", "en", "a"),
    ]
    rows = [(i, t, g, s, None if t is None else len(t), None, "k", None, 1, None, "x") for i, t, g, s in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
