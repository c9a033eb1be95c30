import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """A frame of documents from texts, or from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) if isinstance(r, tuple) else (i, r, "en", "s", 0) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def texts(spark):
    """All documents of the smallest table: id and text."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
