import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()), T.StructField("_id", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text), with columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
