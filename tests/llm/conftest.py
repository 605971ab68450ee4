import pytest

SCHEMA = "doc_id bigint, text string, fp string, t int, words string, n int, row string, score string, text_hash int, k1 int, label string, spans string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) with columns that clash with names used inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "w", 2, "r", "s", 3, 4, "l", "p") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def by_id():
    def collect(df, key="doc_id"):
        out = {}
        for r in df.collect():
            out.setdefault(r[key], []).append(r.asDict())
        return out

    return collect
