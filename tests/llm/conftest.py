import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) or (doc_id, text, lang, source) as a table of documents."""

    def make(rows, schema=DOCS):
        full = [(*row, *("en", "s")[len(row) - 2 :], None)[:4] + (None,) for row in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def words():
    """Words that no two calls share, so that texts made of them differ."""
    import random

    pick = random.Random(17)

    def make(n):
        return ["".join(pick.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]

    return make
