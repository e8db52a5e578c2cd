import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, file string, score double, unit long, word string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with other columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, 1, 2, "f", 0.5, 7, "w") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a repeated row, ties, one very long text, a null id."""
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta's", "épée", "zeta,", "日本語", "x1", "12", "--"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    some = prose(60)
    return [(1, None), (2, ""), (3, "  \t\n "), (4, some), (4, some), (5, some), (6, "one two"), (7, "One\ttwo"), (8, prose(30000)), (None, some), (9, prose(80)), (10, "a  b   c \n d"), (11, "<|endoftext|> x  <|endoftext|>y"), (-12, prose(40))]
