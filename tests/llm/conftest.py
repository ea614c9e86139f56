import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def real(spark, small):
    """The whole smallest table, as a frame and as rows."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
