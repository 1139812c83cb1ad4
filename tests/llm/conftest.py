import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def docs(spark):
    """Make a document table from texts, or from (id, text) pairs."""
    def make(rows, **extra):
        full = []
        for k, row in enumerate(rows):
            doc_id, text = row if isinstance(row, tuple) else (k, row)
            full.append((doc_id, text, "en", "src", None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df.repartition(3)

    return make
