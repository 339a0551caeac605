import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from (doc_id, text, lang, source) tuples, with clashing extra columns."""

    def make(rows, extra=True):
        data = [(*r, *(None,) * (4 - len(r))) for r in rows]
        docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
        if extra:
            names = ("shard", "words", "_w", "node", "component", "value", "key", "n_words", "kept", "_row", "_score")
            for name in names:
                docs = docs.selectExpr("*", f"'x' AS {name}")
        return docs

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, ties, repeated rows and a long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None),
        (5, "the same text " * 5, "fr", "b"), (5, "the same text " * 5, "fr", "b"), (6, "the same text " * 5, "fr", "b"),
        (None, "no id at all", "en", "c"), (None, None, None, None), (7, long, "en", "c"), (8, "é ß 漢字 😀 x", None, "b"),
    ]
