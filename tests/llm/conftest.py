import pytest

#: Documents with nulls, empty, short and very long texts, ties and repeated
#: rows, and extra columns named as the operators name their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, key string, part int, band int, token string, features string, refers_to long, url string"
LONG = "long text of many words " * 20_000


@pytest.fixture(scope="session")
def odd_rows():
    texts = [(1, "the same words in the same order again"), (2, "the same words in the same order again"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (6, "one two"), (7, "日本語 été 😀 \x00 zero"), (8, LONG), (9, "x" * 9000), (None, "no id at all here"), (10, "12345 !!! ---")]
    return [(i, t, "en" if t else None, None if t is None else "src", None, 5, "k", 1, 2, "t", "f", 9, "u") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
