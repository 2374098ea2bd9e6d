import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, near copies."""
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(400)}" for _ in range(300))
    near = base.replace(" w1", " v1", 1)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, None, None, None),
        (3, near, "en", "b", 1),
        (4, None, "en", "a", 1),
        (5, "", "fr", "a", 1),
        (6, " \t\n\n ", "fr", "a", 1),
        (7, "one", "en", "c", 1),
        (7, "one", "en", "c", 1),
        (8, "x" * 50_000, "en", "a", 1),
        (9, " ".join(str(r.random()) for _ in range(30_000)), "en", "a", 1),
        (None, base + "\n" + base, "en", "a", 1),
        (None, None, None, None, None),
        (10, "日本語 текст ελληνικά é́ <|endoftext|> 🎉", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
