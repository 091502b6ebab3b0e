import pytest



@pytest.fixture(scope="session")
def frame(spark):
    """Documents with clashing extra columns."""
    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, schema)
        extra = [c for c in ("n", "rid", "kept", "words", "text_x", "score", "line", "cid") if c not in df.columns]
        return df.select("*", *[F.lit("clash").alias(c) for c in extra])
    return make
