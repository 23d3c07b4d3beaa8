import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long, key string, line string, n_card int"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 9.0, 9, 9, "k", "l", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
