import random

import pytest

WORDS = "alder birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew ash".split()


@pytest.fixture(scope="session")
def prose():
    """n → a text of n words, the same for the same seed."""

    def make(seed: int, n: int, words=WORDS) -> str:
        draw = random.Random(seed)
        return " ".join(draw.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    long = "\n".join(prose(i, 60) for i in range(120))
    rows = [
        (1, prose(1, 80), "en", "a", 1, "x"), (2, prose(1, 80), "en", "a", 1, "x"),
        (2, prose(1, 80), "en", "a", 1, "x"), (3, None, "en", "a", None, None),
        (4, "", None, None, 0, "y"), (5, long, "en", "b", 9, "z"), (None, prose(2, 70), None, "b", 1, "z"),
        (6, "\n\n", "en", None, 2, "q"), (7, "1234 !!", "en", "b", 7, "q"), (8, "short", "en", "c", 5, "r"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `Key` string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
