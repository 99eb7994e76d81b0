import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, shard int, node string, media string, `__x` int"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def row(ident, text, source="a"):
    return (ident, text, "en", source, len(text or ""), None, "x", 1, None, "m", None)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(3)
    long = prose(rng, 40_000)
    texts = [None, "", " \n\t ", "one", "two words", long, "É" * 5000, "a\n\n\nb " * 50, "same same same same same same", "\x00odd\x1f bytes"]
    rows = [row(i, t, None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [rows[5], rows[1], rows[8]]  # repeated rows
    rows += [row(50, rows[5][1]), row(51, rows[8][1]), (None,) * 11, row(None, "no id at all here"), row(7, "the same id with another text")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(i, None if i == 4 else i % 2, None if i == 5 else (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
