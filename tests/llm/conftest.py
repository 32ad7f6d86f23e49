from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
PEOPLE = "doc_id long, text string, source string, score double, fp long, span string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, a null id, and columns named like the operators' own."""
    long_text = " ".join(f"word{k % 997} other{k % 13}" for k in range(60_000))
    rows = [
        (1, None, "a", 0.5, 1, "x"), (2, "", "a", None, 2, None), (3, " \n\t ", None, 0.1, 3, ""), (4, long_text, "b", 0.2, 4, "y"),
        (5, long_text, "b", 0.2, 4, "y"), (6, "one two three four five six seven eight nine ten eleven", "b", 0.9, 0, "z"),
        (6, "one two three four five six seven eight nine ten eleven", "b", 0.9, 0, "z"), (None, "a text without an id " * 30, None, 0.3, 9, "q"),
    ]
    return spark.createDataFrame(rows, PEOPLE)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
