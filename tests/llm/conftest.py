import pytest
from pyspark.sql import Row


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with an extra column whose name clashes with internal ones."""
    from annospark.llm.common import prepare
    prepare(spark)

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame([Row(*r) for r in rows], schema)
        return df.selectExpr("*", "'x' AS token", "'y' AS th", "'z' AS path", "'g' AS gid")
    return make
