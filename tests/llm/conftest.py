import pytest


@pytest.fixture(scope="session")
def shipped(spark):
    from tidegraph.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture
def docs(shipped):
    """A maker of documents with ids, texts and a column that clashes with names in use inside."""

    def make(texts, ids=None, source="s"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", source, None if t is None else len(t), "x") for i, t in zip(ids, texts, strict=True)]
        return shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
