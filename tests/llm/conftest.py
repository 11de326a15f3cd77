from __future__ import annotations

import pytest

LONG = "word%d of a very long text that says %d things about %d others. "


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    shared = "this passage of well over fifty bytes stands in several of the documents, word for word."
    long = "".join(LONG % (i, i * 7, i * 13) for i in range(3000))
    rows = [
        (1, f"first {shared} end of one", "en", "a", 1, 1, "x"),
        (2, f"second {shared} end of two", "en", "b", 2, 2, "x"),
        (2, f"second {shared} end of two", "en", "b", 2, 2, "x"),
        (3, None, "en", "a", None, None, None),
        (4, "", None, None, 0, 0, ""),
        (5, " \t\n ", "de", "c", 3, 0, "y"),
        (6, long, "en", "a", 4, 1, "y"),
        (7, long + "tail", "en", "a", 4, 1, "y"),
        (8, "a", "fr", "b", 1, 1, "y"),
        (9, "ünïcödé " * 20, "de", "c", 1, 1, "z"),
        (9, "ünïcödé " * 20, "de", "c", 1, 1, "z"),
        (10, "You idiot, you worthless 1d10t and stuuupid clown!", "en", "c", 1, 1, "z"),
        (None, f"nobody {shared} end of none", "en", "a", 1, 1, "z"),
        (11, "x" * 200, "en", "", 1, 1, "z"),
        (12, "x" * 200, "en", "", 1, 1, "z"),
    ]
    columns = "doc_id long, text string, lang string, source string, size long, shard int, row string"
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="session")
def hard_labels(spark):
    rows = [(1, 0, 0), (2, 1, 0), (2, 1, 0), (10, 0, 1), (None, 1, 1), (99, None, None), (6, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def hard_items(spark):
    rows = [
        (1, "passage of well over fifty bytes stands in several of the documents word for word"),
        (1, "end of two"),
        (2, None),
        (3, "  ,. "),
        (None, "End of ONE!"),
        (4, "end of two"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")
