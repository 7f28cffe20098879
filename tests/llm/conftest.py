import random

import pytest


@pytest.fixture()
def rng():
    return random.Random(7)


@pytest.fixture()
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(0, None, "x"), (1, "", None), (2, "a", "y"), (3, long, "y"), (4, long, "y"), (5, " \n\t ", ""), (6, "é" * 70, "z"), (6, "é" * 70, "z"), (7, "one two three four five six. " * 30, "z"), (None, "stray row", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "'a' as body", "1 as key", "0L as n_chars", "'b' as runs", "2 as digest")


def texts(rng, n, alphabet="abcé \n", longest=400):
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))) for i in range(n)]
