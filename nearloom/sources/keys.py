"""Row keys for tables that have none.

A key must be the same whenever the plan runs again, so it is made once and written to the shared
checkpoint folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is made only on one machine that has none set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="nearloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, until ``forget``; for what is soon replaced."""
    path = f"{checkpoint_folder(df.sparkSession)}/nearloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["stored_path"] = path
    return table


def forget(table: DataFrame | None) -> None:
    """Delete what ``stored`` wrote."""
    if table is not None:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["stored_path"])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    if name in df.columns:
        return df
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))
