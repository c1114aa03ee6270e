import pytest
from pyspark.sql import functions as F

from nearloom.operators.index import VectorIndex
from nearloom.sources.tables import grid, read_vectors, write_table
from nearloom.streaming.append import append_stream


def test_vectors_are_cast_and_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(grid(spark, 1, 3).withColumn("embedding", F.col("embedding").cast("array<double>")), path)
    rows = read_vectors(spark, path, dims=3)
    assert rows.schema["embedding"].dataType.elementType.typeName() == "float" and rows.count() == 27
    with pytest.raises(Exception, match="dimensions"):
        read_vectors(spark, path, dims=4).collect()


def test_stream_feeds_an_index(spark, tmp_path):
    index = VectorIndex.create(grid(spark, 1, 3), str(tmp_path / "i"), "i")
    more = str(tmp_path / "more")
    grid(spark, 4, 5).withColumn("vec_id", F.col("vec_id") + 1000).write.parquet(more)
    stream = spark.readStream.schema(spark.read.parquet(more).schema).parquet(more)
    append_stream(stream, index.path, str(tmp_path / "c")).awaitTermination()
    assert index.info().first()["count"] == 27 + 8 and index.search([5, 5, 5], 1).first().key >= 1000
