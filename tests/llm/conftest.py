import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, blank and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997} and" for i in range(30_000)) + "."
    rows = [
        (1, "", "en", "a", 0, "x", 1), (2, None, "en", "a", None, "x", 1), (3, "  \t\n ", None, None, 5, None, None),
        (None, "A text without an id that says something.", "en", "b", 1, "y", 2), (None, None, None, None, None, None, None),
        (4, long, "en", "a", 1, "z", 3), (5, "one", "en", "b", 3, "z", 3), (6, "two words", "fr", "b", 9, "z", 3),
        (7, "Same row, same id. It comes twice. Nothing else is here.", "en", "a", 1, "q", 4),
        (7, "Same row, same id. It comes twice. Nothing else is here.", "en", "a", 1, "q", 4),
        (8, "Same row, same id. It comes twice. Nothing else is here.", "en", "c", 1, "q", 4),
        (9, "émoji \U0001f600 and é   spaces", "xx", "c", 1, "q", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
