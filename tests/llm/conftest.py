import pytest

from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType())]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source), with extra columns whose names the operators use inside."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOC)

    return make
