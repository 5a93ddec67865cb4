import random

import pytest

SCHEMA = "doc_id long, text string, n_tokens string, score string, label string, word string"


def edge_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["alpha", "beta", "the", "of", "mit", "license", "MIT", "License,", "général", "über.", "don't", "x", "42", "!!", "\t", "  ", "\n\n"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return [None, "", " ", "\n", "one", "one two", None, *made, made[0], made[0], "z" * 3000, "long " * 4000]


@pytest.fixture(scope="session")
def edge_rows():
    return [(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(edge_texts())] + [(3, "\n", "c", "c", "c", "c"), (None, "no id here", "c", "c", "c", "c")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Nulls, empty and long texts, ties and repeated rows, columns with clashing names."""
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
