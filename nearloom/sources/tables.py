"""Reading embedding tables and checking them where they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, path: str, vec: str = "embedding", dims: int | None = None, format: str = "parquet") -> DataFrame:
    """A table whose ``vec`` column is ``array<float>``; doubles are cast.

    With ``dims``, a vector of another length fails the job that reads it.
    """
    df = spark.read.format(format).load(path)
    column = F.col(vec).cast("array<float>")
    if dims is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a vector of {vec} has not {dims} dimensions but "), F.size(column).cast("string")))
        column = F.when(column.isNull() | (F.size(column) == dims), column).otherwise(wrong)
    return df.withColumn(vec, column)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def grid(spark: SparkSession, least: int = 1, most: int = 9) -> DataFrame:
    """All vectors of three whole numbers, with a key: small exact fixtures."""
    r = lambda n: spark.range(least, most + 1).toDF(n)
    n = most - least + 1
    key = ((F.col("a") - least) * n + F.col("b") - least) * n + F.col("c") - least
    return r("a").crossJoin(r("b")).crossJoin(r("c")).select(key.alias("vec_id"), F.array(*[F.col(x).cast("float") for x in "abc"]).alias("embedding"))
