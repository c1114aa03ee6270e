"""Exact nearest neighbours: top-k, filtered, joined to metadata, and as lists per group.

All are declarative: filters and column pruning reach the scan, top-k runs as per-partition heaps
(``TakeOrderedAndProject``) and per-group top-k as partial and final ``WindowGroupLimit``.  Ties
go to the smaller key.  Vectors that are null sort last, as nulls do in the order of a query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.functions import distances


def with_distance(df: DataFrame, query: Sequence[float] | DataFrame, metric: str = "l2sq", vec: str = "embedding", dims: int | None = None, name: str = "dist") -> DataFrame:
    """``df`` with its distance to one query vector: numbers, or a table of one row and one column."""
    if isinstance(query, DataFrame):
        if len(query.columns) != 1:
            raise ValueError("the query table must have one column")
        one = query.limit(1).toDF("__query")  # one row, so its broadcast is bounded
        return df.crossJoin(F.broadcast(one)).withColumn(name, distances.distance(metric, F.col(vec), F.col("__query"), dims)).drop("__query")
    values = list(query)
    return df.withColumn(name, distances.distance(metric, F.col(vec), distances.vector(values), len(values)))


def knn(df: DataFrame, query: Sequence[float] | DataFrame, k: int, metric: str = "l2sq", key: str = "vec_id", vec: str = "embedding", where: Column | str | None = None, offset: int = 0, dims: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` after skipping ``offset``, with column ``dist``, nearest first.

    ``where`` holds for every row that comes back, and min(k, matches) rows do.
    """
    if k < 0 or offset < 0:
        raise ValueError("k and offset must not be negative")
    rows = df if where is None else df.where(where)
    ordered = with_distance(rows, query, metric, vec, dims).orderBy(F.col("dist").asc_nulls_last(), F.col(key).asc())
    return (ordered.offset(offset) if offset else ordered).limit(k)


def knn_with_metadata(df: DataFrame, metadata: DataFrame, query: Sequence[float] | DataFrame, k: int, on: Column, metric: str = "l2sq", key: str = "vec_id", vec: str = "embedding", where: Column | str | None = None, order: Sequence[str] = (), dims: int | None = None) -> DataFrame:
    """Nearest rows of an inner join with metadata; metadata that repeats a key repeats the row."""
    joined = df.join(metadata, on)
    if where is not None:
        joined = joined.where(where)
    rows = with_distance(joined, query, metric, vec, dims)
    return rows.orderBy(F.col("dist").asc_nulls_last(), F.col(key).asc(), *[F.col(c).asc() for c in order]).limit(k)


def _ranked(df: DataFrame, value: Column, by: Column, k: int, groups: Sequence[Column], tie: str) -> DataFrame:
    keys = [g.alias(f"__g{i}") for i, g in enumerate(groups)]
    rows = df.select(*keys, value.alias("__value"), by.alias("__by"), F.col(tie).alias("__tie")).where("__value is not null and __by is not null")
    order = [F.col("__by").asc(), F.col("__tie").asc()]
    if not groups:
        return rows.orderBy(*order).limit(k).withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    over = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(over)).where(F.col("__rank") <= k)


def _listed() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__value"))), lambda x: x["__value"])


def min_by_k(df: DataFrame, value: Column, by: Column, k: int, tie: str = "vec_id", name: str = "items") -> DataFrame:
    """One row: the values of the ``k`` least ``by`` in order, or null if there are none.

    Rows whose value or order is null are skipped.
    """
    listed = _ranked(df, value, by, k, [], tie).agg(_listed().alias(name))
    return listed.select(F.when(F.size(name) > 0, F.col(name)).alias(name))


def grouped_min_by_k(df: DataFrame, groups: dict[str, Column], value: Column, by: Column, k: int, tie: str = "vec_id", name: str = "items") -> DataFrame:
    """A row for each group (null is a group of its own) with the values of its ``k`` least ``by``."""
    rows = _ranked(df, value, by, k, list(groups.values()), tie)
    listed = rows.groupBy(*[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups)]).agg(_listed().alias(name))
    return listed
