import pytest

from deskdb.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, digest binary, score double"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, columns with clashing names."""
    texts = ["a b c", " a  b c ", None, "", "\t\n", "z" * 30_000 + " end", "word " * 4_000, "a b c", "ünï çødé 日本 😀", "A b c"]
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, 1, None, None, None, None) for k, t in enumerate(texts)]
    rows += [(None, "a b c", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "", "en", "s1", 0, True, 1, b"x", 0.5), (3, "", "en", "s1", 0, True, 1, b"x", 0.5), (1, "other text for id one", "en", "s1", 0, True, 1, b"x", 0.5)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    yield
    common.clear_scratch(spark)
