import pytest

SCHEMA = "lang string, doc_id long, text string, n_chars long, source string, block int, blob string, _c0 string, score double"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "lorem ipsum dolor sit amet " * 20_000
    passage = "a passage of well over fifty bytes that several documents share word for word "
    rows = [
        ("en", 1, passage + "first tail", 1, "a", 1, "x", "y", 0.5), ("en", 2, "second head " + passage, 1, "a", 1, "x", "y", 0.5), ("en", 2, "second head " + passage, 1, "a", 1, "x", "y", 0.5),
        ("en", 3, None, None, None, None, None, None, None), (None, 4, "", 0, "b", 0, "", "", 0.0), ("de", None, "ein Text ohne Nummer und " + passage, 1, "c", 1, "x", "y", 0.1), ("de", 5, long, 1, "c", 1, "x", "y", 0.1),
        ("de", 6, long, 1, "c", 1, "x", "y", 0.1), ("en", 7, " \t\n", 1, "c", 1, "x", "y", 0.1), ("en", 8, "日本語 👍🏽 é", 1, "c", 1, "x", "y", 0.1), ("en", 9, passage + "first tail", 1, "a", 1, "x", "y", 0.5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
