import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, fp string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    copy = "one two three four five six seven eight nine ten " * 6
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 3), (4, long, "en", "b", len(long)),
        (5, copy, "en", "b", 10), (6, copy, "fr", None, 10), (6, copy, "fr", None, 10), (6, "six again " * 30, "fr", "c", 10),
        (None, copy, "fr", "c", 1), (None, None, "fr", "c", 1), (None, None, "fr", "c", 1), (9, "naïve <|endoftext|> it's  'll\n\nx y \x1c z", "en", "", None),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
