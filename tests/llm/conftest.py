import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text), with an extra column whose name an operator might want."""

    def make(rows, extra="row"):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumn(extra, F.lit(1)) if extra else df

    return make
