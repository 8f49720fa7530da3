import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today. " * 3, "a", 1),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today. " * 3, "b", 2),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today. " * 3, "b", 2),
        (3, None, None, None),
        (4, "", "a", 0),
        (5, " \n \t ", "a", 0),
        (6, "word " * 30_000, "c", 9),
        (7, "x" * 100_000, "c", 9),
        (8, "mail me at ann.lee@example.com or +1 (555) 010-9999, é ü ñ", "d", 5),
        (None, "no id here at all", "d", 5),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, source string, n int, fp string, id string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n int")
