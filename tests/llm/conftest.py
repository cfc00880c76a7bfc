import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(autouse=True)
def checkpoints(spark):
    from icefathom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs."""

    def make(rows, lang="en"):
        full = [(k, t, lang, "s", None if t is None else len(t)) for k, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def samples(spark, small):
    """(doc_id, text) of the smallest given table."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
