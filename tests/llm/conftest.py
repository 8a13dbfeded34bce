import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, `bucket` string, rep long"


@pytest.fixture
def docs(spark):
    """A maker of documents with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "x", 7) for i, t, *rest in rows for s in [rest[0] if rest else "s0"]]
        return spark.createDataFrame(full, DOC)

    return make
