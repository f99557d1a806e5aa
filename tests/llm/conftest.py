import pytest


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows as a table of a data folder, in several files."""

    def write(name, rows, schema, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
