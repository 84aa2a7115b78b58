import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, line string, keep int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns named like those the operators use inside."""
    def make(rows):
        full = [(i, t, None, s, None if t is None else len(t), 7, "x", None) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make
