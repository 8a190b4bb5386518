import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Rows of ``documents`` from (doc_id, text) pairs."""

    def make(pairs, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOC)
        for name in extra:  # columns whose names operators use themselves
            df = df.withColumn(name, F.lit("x"))
        return df

    return make
