"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one Arrow batch may hold before a Python operator yields its output.
FLUSH_BYTES = 8 << 20

#: Ids that may be broadcast: some 64 MB as a hashed relation.  Always counted first.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; always through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names, shared by all executors.

    Where it is unset, one machine (a local master, as in tests) gets a temporary folder; a cluster
    gets an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="nearloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that live as long as the ``with`` block.

    A table is computed once and ends the lineage of what reads it, so a lost executor costs no
    more than the step that runs.  Results must be ``checkpointed`` before the block ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/nearloom-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)
        self.tidy()

    def tidy(self) -> None:
        """Shuffle files that nothing reads any more go when the driver collects its garbage: ask for it."""
        gc.collect()
        self.spark._jvm.System.gc()

    def put(self, df: DataFrame) -> DataFrame:
        path, self.made = f"{self.folder}/{self.made}", self.made + 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.__dict__["scratch_path"] = path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``put`` made and nothing reads any more."""
        for t in tables:
            if t is not None:
                self._delete(t.__dict__["scratch_path"])

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def split_row(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``df`` as columns ``__id``, ``__text`` and ``__rest`` (a struct of everything else).

    Other columns ride along under one private name, so an operator's own names cannot clash
    with them.  ``__rest`` always has at least one field.
    """
    rest = [c for c in df.columns if c != text_col]
    fields = [F.col(f"`{c}`") for c in rest] or [F.lit(None).cast("int").alias("__none")]
    return df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.struct(*fields).alias("__rest")), rest


def joined_row(df: DataFrame, columns: list[str], text_col: str, extra: dict[str, str]) -> DataFrame:
    """The reverse of ``split_row``: the columns in their old order, then ``extra`` (new name: column).

    A new column takes the place of an old one of the same name.
    """
    old = [F.col("__text").alias(c) if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in columns if c not in extra]
    return df.select(*old, *[F.col(v).alias(k) for k, v in extra.items()])


def binary_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give memory that Python has freed back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``, with ``release`` at the end of each task."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return g


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(releasing(f), schema)
