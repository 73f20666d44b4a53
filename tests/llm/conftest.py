import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, mark int, size long, kind string"


def documents(spark, rows, schema=DOCS):
    """Documents with extra columns whose names operators use within."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 0.5, 7, 9, "k") for i, t, lang, source in rows], schema)


@pytest.fixture
def make(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, copies."""
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本", "é"]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, long = line(60), line(4000)
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one", "en", "b"), (5, "one two", None, "a"),
        (6, line(50) + " " + shared, "en", "a"), (7, shared + "\n" + line(9), "de", "a"), (8, long, "en", "a"), (9, long, "en", "b"),
        (10, "x " * 100, "en", "a"), (11, line(34), "en", "a"), (12, line(35), "en", "c"), (13, long[:-3], "en", "a"),
        (7, shared + "\n" + line(9), "de", "a"), (14, shared, "fr", "a"), (14, shared, "fr", "a"), (None, shared, "fr", "a"), (None, None, None, None),
        (15, "a b c \x1c d", "en", "a"), (16, "A" * 5000, "en", "a"), (17, shared.upper(), "en", "a"),
    ]
