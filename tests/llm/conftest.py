import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, size int"


def text_of(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns named as inner ones are."""
    rng = random.Random(5)
    base = text_of(rng, 120)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", None, None, None), (None, base, "fr", "a", 1),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (5, "", "en", "a", 0), (6, "  \n ", None, "a", 4), (7, "!!! ???", "en", None, 7), (8, "one", "fr", "a", 3),
        (9, text_of(rng, 20000), "en", "b", None), (10, "x" * 50000, "en", "b", 1), (11, "0" * 30000, "en", "b", 1), (12, "née 漢字 😀 " * 30, "fr", "b", 1), (None, None, None, None, None),
    ] + [(100 + i, text_of(rng, rng.randint(1, 80)), ("en", "fr")[i % 2], "c", 1) for i in range(30)]
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
