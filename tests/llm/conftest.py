import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from (doc_id, text) pairs, with further columns whose names operators use."""

    def make(rows, lang="en"):
        from pyspark.sql import functions as F

        data = [(i, t, lang if t else None, "src", len(t or "")) for i, t in rows]
        plain = spark.createDataFrame(data, DOCS)
        clashing = {c: F.lit("own") for c in ("kept", "fp", "label", "list", "ids", "score", "_row", "_kept", "value")}
        return plain.withColumns(clashing)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "plain words that stay as they are in the text of this row"),
    (4, "plain words that stay as they are in the text of this row"),
    (None, "a row without an id"),
    (6, "word " * 30000),
    (7, "x" * 60000),
    (8, "ünï çödé 中文 текст <|endoftext|>   end"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
