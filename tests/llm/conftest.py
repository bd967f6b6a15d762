import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) rows, with clashing extra columns."""

    def make(rows, more="shard string, n_words string, size string"):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, f"{COLUMNS}, {more}").repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random prose: n words from a small vocabulary."""

    def make(n, seed, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows with nulls, empty, blank, very long and repeated texts."""
    long = prose(30_000, 1)
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (6, "Same text"), (6, "Same text"), (None, "same text"), (None, None), (7, "%%% !!!"), (8, "ä ß ñ"), (9, "one"), (10, "½ ²"), (11, "Ⅷ"), (12, "①②")]
