import random

import pytest


def prose(seed, words, vocabulary=900):
    """Words of made-up prose, the same for a seed."""
    r = random.Random(seed)
    return [f"{r.choice('bdfglmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{k % vocabulary}" for k in (r.randrange(10**6) for _ in range(words))]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, doc string, words string, key int, n int, hash string, at int, class int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(prose(1, 30_000))
    copy = "\n".join(" ".join(prose(k, 12)) for k in range(2, 8))
    rows = [
        (1, None, "en"), (2, "", None), (3, long, "en"), (4, copy, "en"), (5, copy, "de"), (5, copy, "de"), (6, " \n\t\n ", "en"),
        (7, "one two", "en"), (8, "a" * 60_000, None), (None, copy, "en"), (None, "odd \U0001f600 ퟿ text", "fr"), (9, "x " * 4_000, "en"),
        (10, copy + "\n" + " ".join(prose(99, 30)), "en"),
    ]
    return spark.createDataFrame([(i, t, g, "s", 1, "d", "w", 2, 3, "h", 4, 5) for i, t, g in rows], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def as_docs(spark):
    def make(texts, lang="en"):
        rows = [(i, t, lang) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string")

    return make


@pytest.fixture(scope="session")
def make_prose():
    return prose
