import pytest

from tidewright.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("llm-tests", "8", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, a missing id, extra columns."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))
    rows = [
        (1, "The same words are here twice in a row, the same words are here", "en", "a", 10),
        (2, "The same words are here twice in a row, the same words are here", "en", "a", 10),
        (2, "The same words are here twice in a row, the same words are here", "en", "a", 10),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "fr", "b", 4), (6, "one two", "en", "a", 7),
        (None, "a row without an id but with some words in it", "en", "a", 40), (7, long, "de", "c", len(long)),
        (8, "é\u0301 \U0001f600 Straße [INST] </s> ÀÉ one\x0btwo\u00a0three", "fr", "b", 30),
    ]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "key", "part", "n", "a", "range", "row", "words", "kind", "class", "piece", "print", "y"):
        out = out.selectExpr("*", f"'clash' AS {name}")
    return out


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
