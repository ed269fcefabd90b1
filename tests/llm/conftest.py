import pytest
from support import SCHEMA, words


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny and long texts, repeated rows, and a null id."""
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "a"), (5, words(4000, 1)), (6, "mit license"), (6, "mit license"), (None, "some text without an id"), (7, "!!! 123"), (8, words(30, 2)), (9, words(30, 2))]
    return spark.createDataFrame([(a, b, None, 1, "x", 2, "y") for a, b in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
