import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from texts or (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            doc, text, lang, source = row if len(row) == 4 else (*row, "en", "src0")
            full.append((doc, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return make
