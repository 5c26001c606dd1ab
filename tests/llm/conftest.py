import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs over a few partitions."""
    def make(rows, extra=None):
        made = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(made, DOCS).repartition(3)
        for name in extra or ():  # columns with the names that an operator uses inside
            frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return make
