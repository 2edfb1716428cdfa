import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, size long, `class` string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text[, source]); extra columns have names that the operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), 0.5, "k", 7, "c") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
