import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string"


@pytest.fixture
def docs(spark):
    """A maker of documents: texts (or (doc_id, text) pairs), with extra columns whose names clash."""

    def make(texts, source=None):
        rows = []
        for k, t in enumerate(texts):
            doc_id, text = t if isinstance(t, tuple) else (k, t)
            rows.append((doc_id, text, "en", source(k) if source else f"s{k % 3}", len(text or ""), "x", "y"))
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


ODD = [None, "", "a", " \n\t ", "the cat sat on the mat", "the cat sat on the mat", "The  Cat sat\non the mat", "ÄÖ ß straße ﬁn é", "x " * 5000, "日本語 テスト \U0001f600", "a" * 3000]


@pytest.fixture
def odd():
    return list(ODD)
