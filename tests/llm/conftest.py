import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, key int, slot string, body string, number int"


@pytest.fixture
def docs(spark):
    """Make documents from (id, text), with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1, "x", "y", 2) for i, t in rows]
        return spark.createDataFrame(full, NAMES)

    return make
