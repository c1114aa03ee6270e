"""Recall of every index query, with each vec_id divisible by 100 as query, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.operators import knn as exact
from nearloom.operators import knn_join as joins
from nearloom.operators import rabitq
from nearloom.operators.index import VectorIndex
from nearloom.operators.knn_join import matrix_distances

LEAST = 0.9


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def asked(rows):
    return [(r.vec_id, list(r.embedding)) for r in rows.where("vec_id % 100 = 0").orderBy("vec_id").collect()]


def nearest(rows, q, metric, k=10):
    """Ids of the k nearest, ties to the smaller id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    return set(ids[np.lexsort((ids, matrix_distances(metric, np.array([q]), x)[0]))[:k]].tolist())


def recall(rows, asked, search, metric="l2sq", key="key"):
    held = [tuple(r) for r in rows.select("vec_id", "embedding").collect()]
    hit = want = 0
    for _, q in asked:
        best, found = nearest(held, q, metric), [r[key] for r in search(q).collect()]
        assert len(found) == len(set(found)) == len(best)
        hit, want = hit + len(best & set(found)), want + len(best)
    return hit / want


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_one_bit_search_loses_nothing(rows, asked, metric):
    center = rabitq.centroid(rows, 64, metric).first().centroid
    coded = rabitq.with_code(rows, center, metric).cache()
    assert recall(rows, asked, lambda q: rabitq.search(coded, q, 10, center, metric, oversample=1), metric, "vec_id") == 1.0
    q = asked[1][1]
    near = exact.with_distance(coded, q, metric, dims=64)
    gap = [r.gap for r in near.select((F.col("dist") - rabitq.least_distance(F.col("code"), q, center, metric)).alias("gap")).collect()]
    assert min(gap) >= -1e-9 and np.isfinite(gap).all()


def test_quantized_index(rows, asked, tmp_path):
    index = VectorIndex.create(rows, str(tmp_path / "i"), "i", metric="cosine", quantization="rabitq")
    assert recall(rows, asked, lambda q: index.search(q, 10), "cosine") == 1.0


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_graph_index(spark, sf_dir, rows, asked, tmp_path, metric):
    """hnsw_search and hnsw_search_cosine; for l2sq also the filtered ones, and hnsw_crud."""
    index = VectorIndex.create(rows, str(tmp_path / "i"), "i", metric=metric)
    assert recall(rows, asked, lambda q: index.search(q, 10), metric) >= LEAST
    if metric == "l2sq":
        french = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'fr'").select("doc_id")
        ids = ",".join(str(r.doc_id) for r in french.collect())
        for where, keys in (("label = 3", rows.where("label = 3").select("vec_id")), (f"vec_id in ({ids})", french)):
            assert recall(rows.where(where), asked, lambda q, keys=keys: index.search(q, 10, keys)) >= LEAST
        moved = rows.where("label = 3").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "embedding")
        index.delete(rows.where("label = 3").select("vec_id"))
        index.insert(moved)
        index.compact()
        now = rows.where("label <> 3").select("vec_id", "embedding").unionByName(moved)
        assert recall(now, asked, lambda q: index.search(q, 10)) >= LEAST


def test_joins_ask_every_row(spark, sf_dir, rows):
    from nearloom.plans import catalogue

    held = [tuple(r) for r in rows.select("vec_id", "embedding").collect()]
    want = {(i, j) for i, q in held for j in nearest(held, q, "l2sq", 3)}
    got = {(r.qid, r.vec_id) for r in catalogue.queries()["knn_join_k3"](spark, sf_dir).collect()}
    assert got == want and len(want) == 3 * len(held)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_joins_of_large_near_copies(spark, metric):
    g = np.random.default_rng(0)
    base = g.standard_normal((12, 64)) * 1000
    x = np.concatenate([base + g.standard_normal((12, 64)) * 1e-3 * i for i in range(9)]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for found in (joins.knn_join(rows.withColumnRenamed("vec_id", "qid").withColumnRenamed("embedding", "qvec"), rows, 5, metric), rabitq.search_join(rows.withColumnRenamed("vec_id", "qid").withColumnRenamed("embedding", "qvec"), rows, 5, rabitq.centroid(rows, 64, metric).first().centroid, metric, oversample=1)):
        by = {}
        for r in found.orderBy("qid", "rank").collect():
            by.setdefault(r.qid, []).append(r.key)
        for i in range(len(x)):
            d = joins.exact_distances(metric, np.broadcast_to(x[i], x.shape), x)
            assert by[i] == np.lexsort((np.arange(len(x)), d))[:5].tolist()
