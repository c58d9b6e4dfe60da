import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, source]) rows with extra columns whose names the operators use inside."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None, "x", 7) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if extra:
            return spark.createDataFrame(full, schema + ", n_words string, size int")
        return spark.createDataFrame([r[:5] for r in full], schema)

    return make
