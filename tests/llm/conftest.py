import pytest
from pyspark.sql import functions as F


@pytest.fixture
def as_table(spark, tmp_path):
    """Writes rows (doc_id, text, ...) as a Parquet table, with further columns of names that the operators use inside, and reads it."""

    def write(rows, schema="doc_id long, text string", extra=True, name="documents"):
        df = spark.createDataFrame(rows, schema)
        if extra:
            for c in ("row", "token", "n", "node", "size", "score", "found", "hash", "words", "lang_pred", "copies"):
                if c not in df.columns:
                    df = df.withColumn(c, F.lit("x"))
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return spark.read.parquet(f"{tmp_path}/{name}.parquet")

    return write
