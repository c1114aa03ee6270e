"""Queries answered by an index: every vec_id divisible by 100 asks, against all rows.

Graph searches are approximate, so what is stated in SQL is what must hold of each query's answer:
how many rows come back, that each passes the filter with its true distance, and that at least
nine in ten of the true neighbours are among them.  Exact ones state their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.operators.index import VectorIndex
from nearloom.operators.knn_join import knn_join
from nearloom.sources.keys import checkpoint_folder, checkpointed

Query = Callable[[SparkSession, str], DataFrame]
ASKED, LEAST = "vec_id % 100 = 0", 0.9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where(ASKED).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _with_index(spark: SparkSession, sf_dir: str, answer: Callable[[VectorIndex, DataFrame], DataFrame], **options) -> DataFrame:
    """``answer(index, embeddings)``, written before the index, made for it alone, is dropped."""
    e = _table(spark, sf_dir, "embeddings")
    index = VectorIndex.create(e, f"{checkpoint_folder(spark)}/nearloom-index-{uuid.uuid4().hex}", "embeddings_idx", table="embeddings", **options)
    try:
        return checkpointed(answer(index, e))
    finally:
        index.drop()


def _judged(found: DataFrame, queries: DataFrame, rows: DataFrame, k: int, metric: str) -> DataFrame:
    """For each query: rows found, whether all are rows of the table at their true distance, and the recall."""
    best = knn_join(queries, rows, k, metric).select("qid", "key", F.lit(True).alias("best"))
    true = found.join(queries, "qid").join(rows.select(F.col("vec_id").alias("key"), "embedding"), "key", "left")
    from nearloom.functions import distances

    d = distances.distance(metric, F.col("embedding"), F.col("qvec"))
    held = true.withColumn("sound", F.coalesce(F.abs(d - F.col("dist")) < 1e-5, F.lit(False))).join(best, ["qid", "key"], "left")
    each = held.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.bool_and("sound").alias("sound"), F.count("best").alias("hit"))
    over = each.agg(F.sum("hit").alias("hits"), F.sum("n").alias("all"))
    return each.crossJoin(F.broadcast(over)).select("qid", "n", "sound", (F.col("hits") >= LEAST * F.col("all")).alias("recalled"))


def _judged_sql(k: int, where: str = "true", asked: str = ASKED) -> str:
    return f"SELECT q.vec_id AS qid, least({k}, (SELECT count(*) FROM embeddings WHERE {where})) AS n, true AS sound, true AS recalled FROM embeddings q WHERE {asked}"


_SPARK: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_FR = "vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')"


def _french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))


def _search(metric: str = "l2sq", where: str | None = None, metadata: bool = False) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        def answer(index: VectorIndex, e: DataFrame) -> DataFrame:
            match = e if where is None else e.where(where)
            match = match.join(_french(spark, sf_dir), "vec_id", "left_semi") if metadata else match
            allowed = None if where is None and not metadata else match.select("vec_id")
            return _judged(index.join(_asked(e), 10, allowed=allowed), _asked(e), match, 10, metric)

        return _with_index(spark, sf_dir, answer, metric=metric)

    return f


for _name, _options, _where in (
    ("hnsw_search", {}, "true"),
    ("hnsw_search_cosine", {"metric": "cosine"}, "true"),
    ("hnsw_search_ip", {"metric": "ip"}, "true"),
    ("hnsw_filtered", {"where": "label = 3"}, "label = 3"),
    ("hnsw_filtered_metadata", {"metadata": True}, _FR),
):
    _SPARK[_name], _SQL[_name] = _search(**_options), _judged_sql(10, _where)


def _rows(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


_D = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def hnsw_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def answer(index: VectorIndex, e: DataFrame) -> DataFrame:
        return _rows(index.join_grouped(_asked(e), 3, e.select("vec_id", "label")), "qid", F.col("group").alias("label"))

    return _with_index(spark, sf_dir, answer)


_SPARK["hnsw_grouped"] = hnsw_grouped
_SQL["hnsw_grouped"] = f"SELECT qid, label, vec_id, round(d, 6) AS dist, rank FROM (SELECT q.vec_id AS qid, e.label, e.vec_id, {_D} AS d, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY {_D}, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.{ASKED}) WHERE rank <= 3"


def hnsw_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for every row of the table."""
    every = lambda e: e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return _with_index(spark, sf_dir, lambda index, e: _judged(index.join(every(e), 3), every(e), e, 3, "l2sq"))


_SPARK["hnsw_join"], _SQL["hnsw_join"] = hnsw_join, _judged_sql(3, asked="true")


def hnsw_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_index(spark, sf_dir, lambda index, e: _rows(index.join(_asked(e), 10), "qid"), quantization="rabitq", metric="cosine")


_SPARK["hnsw_rabitq"] = hnsw_rabitq
_SQL["hnsw_rabitq"] = f"SELECT qid, vec_id, round(d, 6) AS dist, rank FROM (SELECT q.vec_id AS qid, e.vec_id, {_COS} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.{ASKED}) WHERE rank <= 10"


def hnsw_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches after a delete, an insert, an update and a compaction."""

    def answer(index: VectorIndex, e: DataFrame) -> DataFrame:
        moved = e.where("label = 3").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "embedding")
        index.delete(e.where("label = 3").select("vec_id"))
        index.insert(moved)
        index.update(e.where("label = 4").select("vec_id", "embedding"))
        index.compact()
        now = e.where("label <> 3").select("vec_id", "embedding").unionByName(moved)
        return _judged(index.join(_asked(e), 10), _asked(e), now, 10, "l2sq")

    return _with_index(spark, sf_dir, answer)


_SPARK["hnsw_crud"], _SQL["hnsw_crud"] = hnsw_crud, _judged_sql(10)


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not depend on the graph's random levels."""

    def answer(index: VectorIndex, e: DataFrame) -> DataFrame:
        bottom = F.col("levels_stats")[0]["nodes"].alias("bottom_nodes")
        return index.info().select("index_name", "table_name", "metric", "dimensions", "count", "capacity", "quantization", "bytes_per_vector", "vector_memory_usage", bottom)

    return _with_index(spark, sf_dir, answer)


_SPARK["index_info"] = index_info
_SQL["index_info"] = "SELECT 'embeddings_idx' AS index_name, 'embeddings' AS table_name, 'l2sq' AS metric, CAST(64 AS BIGINT) AS dimensions, count(*) AS count, count(*) AS capacity, 'none' AS quantization, CAST(256 AS BIGINT) AS bytes_per_vector, CAST(256 * count(*) AS BIGINT) AS vector_memory_usage, count(*) AS bottom_nodes FROM embeddings"


def queries() -> dict[str, Query]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
