import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("length", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text) rows with two further columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, repeated rows, repeated identifiers, blanks only, and a long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (3, ""), (4, " \n\t "), (5, long), (5, "other text of the same number"), (None, None)]


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
