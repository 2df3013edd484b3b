from __future__ import annotations

import pytest

#: Texts that every operator must take: null, empty, blank, signs only, very long, repeated, odd code points.
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "!!! ??? ***",
    "word " * 60_000,
    "x" * 300_000,
    "Same line that is long enough to be a key of its own, surely.\n" * 3,
    "Grüße aus Öl, naïve façade — \U0001f600 \u0301 \x00 end",
    "one two three",
    "one two three",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under null, repeated and distinct ids, with columns whose names operators use themselves."""
    rows = [(i if i != 2 else None, t, "en", i, "k", "d") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[-1], rows[3], (None, None, None, None, None, None), (5, "another text under an id that is taken", "de", 1, "k", "d")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, block long, `keep` string, `doc` string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(texts, first: int = 0):
        return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    return build
