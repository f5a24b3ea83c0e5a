import pytest
from pyspark.sql import types as T


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text) pairs or longer tuples, with extra columns whose names clash."""

    def make(rows, **extra):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        schema = "doc_id long, text string, lang string, source string"
        frame = spark.createDataFrame(full, schema)
        from pyspark.sql import functions as F

        frame = frame.withColumn("n_chars", F.length("text").cast(T.LongType()))
        for name in ("key", "id", "fp", "a", "b", "root", "text2"):
            frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make
