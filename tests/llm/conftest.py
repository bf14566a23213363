import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) pairs or whole rows."""

    def make(rows):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def sample(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


#: Null and empty texts, one word, blanks, other scripts, a null id, a repeated row, a very long text.
ODD = [(1, None), (2, ""), (3, "word"), (4, " \t\n\x0b "), (5, "Ünï çödé 中文 😀 token"), (None, "no id here at all"), (7, "same row"), (7, "same row"), (8, "a b c d e f " * 30_000), (9, None)]


@pytest.fixture
def odd(docs):
    return docs(ODD)
