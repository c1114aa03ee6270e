"""Edge cases of the exact operators, settings, options, codes, graph and index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.functions import distances, settings
from nearloom.operators import knn as exact
from nearloom.operators import knn_join as joins
from nearloom.operators import rabitq
from nearloom.operators.graph import Graph
from nearloom.operators.index import VectorIndex
from nearloom.operators.knn_join import exact_distances

VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def modular(spark):
    rows = spark.range(500).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * a % m).cast("float") for a, m in ((1, 10), (7, 13), (3, 17))]).alias("embedding"), (F.col("id") % 5).cast("int").alias("label"))
    return rows.cache()


def test_golden_distances(spark):
    grid = spark.sql("select array(float(a.id), float(b.id), float(c.id)) embedding, a.id * 100 + b.id * 10 + c.id vec_id from range(1, 10) a, range(1, 10) b, range(1, 10) c")
    got = exact.knn(grid, [1, 2, 3], 3).collect()
    assert [r.dist for r in got] == [0.0, 1.0, 1.0] and got[0].vec_id == 123


def test_nulls_zero_vectors_and_bounds(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 2), (4, [0.0, 2.0], None)], VEC)
    assert [r.vec_id for r in exact.knn(rows, [1, 0], 4).collect()] == [1, 3, 4, 2]
    assert np.isnan(exact.knn(rows.where("vec_id = 3"), [1, 0], 1, "cosine").first().dist)
    assert exact.knn(rows, [1, 0], 0).count() == 0
    assert exact.knn(rows.limit(0), [1, 0], 3).count() == 0
    with pytest.raises(ValueError):
        exact.knn(rows, [1, 0], -1)
    with pytest.raises(ValueError, match="Unknown metric"):
        exact.knn(rows, [1, 0], 1, "hamming")
    near = exact.with_distance(rows, [1, 0])
    assert exact.min_by_k(near.where("vec_id > 9"), F.col("vec_id"), F.col("dist"), 2).first().items is None
    by = {r.g: r.items for r in exact.grouped_min_by_k(near, {"g": F.col("label")}, F.col("vec_id"), F.col("dist"), 5).collect()}
    assert by == {1: [1], 2: [3], None: [4]}
    found = joins.knn_join(rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), rows, 2).collect()
    assert {r.qid for r in found} == {1, 3, 4} and 2 not in {r.key for r in found} and len(found) == 6


def test_join_in_blocks_equals_one_block(modular):
    asked = modular.where("vec_id < 9").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    one = sorted(map(tuple, joins.knn_join(asked, modular, 4).collect()))
    assert one == sorted(map(tuple, joins.knn_join(asked, modular, 4, block=3).collect())) and len(one) == 36


def test_macros(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "a_id int, a_vec array<float>")
    b = spark.createDataFrame([([1.0, 0.1], "x"), ([0.0, 2.0], "y"), (None, "z")], "b_vec array<float>, b_str string")
    rows = joins.vss_join(a, b, "a_vec", "b_vec", 1, "cosine").collect()
    assert {(r.left_tbl.a_id, r.right_tbl.b_str) for r in rows} == {(1, "x"), (2, "y")} and max(r.score for r in rows) == 1.0
    lists = {r.a_id: [m.row.b_str for m in r.matches] for r in joins.vss_match(a, b, "a_vec", "b_vec", 5).collect()}
    assert lists == {1: ["x", "y"], 2: ["y", "x"]} or lists[1][0] == "x"


@pytest.mark.parametrize("given,says", [({"ef_construction": "foo"}, "must be an integer"), ({"ef_construction": 0}, "at least 1"), ({"M": 0}, "at least 2"), ({"M0": "x"}, "must be an integer"), ({"quantization": "bbq"}, "must be 'rabitq' or 'none'"), ({"quantization": 42}, "must be a string"), ({"metric": "foo"}, "must be one of: cosine, ip, l2sq"), ({"bogus": 1}, "Unknown option for HNSW index: 'bogus'")])
def test_option_errors(given, says):
    with pytest.raises(ValueError, match=says):
        settings.index_options(**given)


def test_options_and_settings(spark):
    assert settings.index_options(M=5).M0 == 10 and settings.index_options(quantization="RaBitQ").quantization == "rabitq"
    assert settings.setting(spark, "hnsw_rabitq_oversample") == 3
    spark.sql("SET hnsw_rabitq_oversample = 0")
    with pytest.raises(ValueError):
        settings.setting(spark, "hnsw_rabitq_oversample")
    spark.sql("SET hnsw_rabitq_oversample = 10")
    assert settings.setting(spark, "hnsw_rabitq_oversample") == 10
    spark.conf.unset("hnsw_rabitq_oversample")


def test_code_sizes_and_estimates(spark, modular):
    assert [rabitq.bytes_per_vector(d) for d in (32, 128, 256, 768)] == [12, 24, 40, 104] and rabitq.bytes_per_vector(32, "none") == 128
    center = rabitq.centroid(modular, 3).first().centroid
    x = np.array([r.embedding for r in modular.orderBy("vec_id").collect()], np.float32)
    assert np.allclose(center, x.mean(0))
    words, norm, vdot = rabitq.encode(x, np.array(center), "l2sq")
    got = rabitq.with_code(modular, center).orderBy("vec_id").collect()
    assert [r.code.bits for r in got] == words.tolist()
    assert np.allclose([r.code.norm for r in got], norm, atol=1e-5) and np.allclose([r.code.vdot for r in got], vdot, atol=1e-5)
    same = spark.createDataFrame([(i, [7.0, 7.0, 7.0], 0) for i in range(5)], VEC)
    flat = rabitq.with_code(same, [7.0, 7.0, 7.0]).first().code
    assert flat.bits == [7] and flat.norm == 0 and flat.vdot == 0
    assert rabitq.search(same, [7, 7, 7], 3, [7.0, 7.0, 7.0]).count() == 3
    assert rabitq.centroid(same.limit(0), 3).first().centroid == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_graph_recall_with_and_without_predicates(metric):
    g = np.random.default_rng(1)
    x = g.standard_normal((600, 32)).astype(np.float32)
    graph = Graph(32, metric, seed=3).build(x)
    for share in (1.0, 0.67, 0.2, 0.02, 0.0):
        allowed = g.random(600) < share
        hit = want = 0
        for q in g.standard_normal((10, 32)).astype(np.float32):
            best = {n for _, n in graph.exact(q, 10, allowed)}
            found = [n for _, n in graph.search(q, 10, 64, allowed)]
            assert len(found) == min(10, int(allowed.sum())) and all(allowed[n] for n in found)
            hit, want = hit + len(best & set(found)), want + len(best)
        assert hit >= 0.9 * want


def test_index_life(spark, modular, tmp_path):
    path = str(tmp_path / "idx")
    index = VectorIndex.create(modular, path, "idx", table="t", shard_rows=200, M=8)
    with pytest.raises(ValueError, match='Index with name "idx" already exists'):
        VectorIndex.create(modular, path, "idx")
    assert VectorIndex.create(modular, path, "idx", if_not_exists=True).options.M0 == 16
    query = [3.0, 4.0, 5.0]
    exact_dist = [r.dist for r in exact.knn(modular, query, 10).collect()]
    assert [round(r.dist, 6) for r in VectorIndex.load(spark, path).search(query, 10).collect()] == [round(d, 6) for d in exact_dist]
    for where in ("label < 5", "label = 2", "label <> 1", "vec_id = 17", "vec_id < 0"):
        keys = modular.where(where).select("vec_id")
        got = index.search(query, 10, keys).collect()
        best = exact.knn(modular, query, 10, where=where).collect()
        assert len(got) == len(best) and {r.key for r in got} <= {r.vec_id for r in keys.collect()}
    row = index.info().first()
    assert row["count"] == row.capacity == 500 and row.dimensions == 3 and row.bytes_per_vector == 12 and row.levels_stats[0].nodes == 500
    index.delete(spark.createDataFrame([(i,) for i in range(100)], "k long"))
    index.insert(spark.createDataFrame([(1000, query, 9)], VEC))
    assert index.search(query, 1).first().key == 1000
    assert min(r.key for r in index.search(query, 50).collect()) >= 100
    assert index.info().first()["count"] == 401
    index.compact()
    row = index.info().first()
    assert row["count"] == row.capacity == 401
    index.update(spark.createDataFrame([(1000, [9.0, 9.0, 9.0], 9)], VEC))
    assert round(index.search(query, 1).first().dist, 6) > 0 or index.search(query, 1).first().key != 1000
    assert "strategy=masked" in index.explain(10, 100) and "strategy=plain" in index.explain(10, 400) and "strategy=exact" in index.explain(10, 3)
    index.drop()
    with pytest.raises(ValueError, match="not found"):
        VectorIndex.load(spark, path)


def test_index_of_nothing(spark, modular, tmp_path):
    index = VectorIndex.create(modular.limit(0), str(tmp_path / "none"), "none")
    assert index.dims == 0 and index.nodes().count() == 0


def test_unrolled_equals_folded(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(20)
    for name in ("l2sq", "cosine", "ip"):
        a = distances.distance(name, F.col("embedding"), F.reverse("embedding"), 64)
        b = distances.distance(name, F.col("embedding"), F.reverse("embedding"))
        assert rows.where(F.abs(a - b) > 1e-9).count() == 0


def test_lengths_that_differ_are_errors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 9.0], 1), (2, [1.0, 0.0, 3.0], 1)], VEC)
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    for f in (lambda: exact.knn(rows, [1, 0], 1), lambda: exact.knn(rows, query, 1), lambda: exact.knn(rows, query, 1, dims=2), lambda: exact.knn(rows, query, 1, dims=3), lambda: joins.knn_join(asked, rows, 1)):
        with pytest.raises(Exception, match="vectors must"):
            f().collect()


def test_index_is_found_by_metric_and_survives_a_crash(spark, modular, tmp_path):
    for name, metric in (("a", "cosine"), ("b", "l2sq"), ("c", "l2sq")):
        VectorIndex.create(modular, str(tmp_path / name), name, table="t", metric=metric)
    find = lambda metric: VectorIndex.find(spark, str(tmp_path), "t", "embedding", metric)
    assert find("l2sq").about["name"] == "b" and find("cosine").about["name"] == "a" and find("ip") is None
    index = VectorIndex.load(spark, str(tmp_path / "b"))
    index._segment(modular.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")), 500)  # written, never made current
    (tmp_path / "b" / "manifests" / "7").mkdir()  # begun, not ended
    again = VectorIndex.load(spark, str(tmp_path / "b"))
    assert again.nodes().count() == 500
    again.update(modular.where("vec_id < 10"))
    assert again.info().first()["count"] == 500 and VectorIndex.load(spark, str(tmp_path / "b")).info().first().capacity == 510
    again.compact()
    assert VectorIndex.load(spark, str(tmp_path / "b")).info().first().capacity == 500
    plan = again._planned(3, modular.where("label = 2").select("vec_id"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard" not in plan and len(again.search([3.0, 4.0, 5.0], 5, modular.where("label = 2").select("vec_id")).collect()) == 5


def test_graph_build_is_quick_and_near_all_of_its_candidates_are_compared_by_products():
    """index_info, hnsw_*: 5,000 rows took 39 s, one walk and many small arrays for each node."""
    g, calls = np.random.default_rng(5), []
    x = g.standard_normal((3000, 32)).astype(np.float32)

    class Counted(Graph):
        def distances(self, q, nodes):
            calls.append(len(nodes))
            return super().distances(q, nodes)

    graph = Counted(32).build(x)
    assert not calls and all(len(near) <= (32 if level == 0 else 16) for links in graph.links for level, near in enumerate(links))
    assert all(i not in near and len(near) == len(set(near)) for i, links in enumerate(graph.links) for near in links)
    hit = sum(len({n for _, n in graph.search(v, 10, 128)} & {n for _, n in graph.exact(v, 10)}) for v in x[::100])
    assert hit >= 0.9 * 10 * len(x[::100])


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_joins_by_an_index_find_copies_by_key(spark, tmp_path, metric):
    """hnsw_search: of 30 copies of each vector a walk finds any ten."""
    g = np.random.default_rng(6)
    base = g.standard_normal((20, 8)).astype(np.float32)
    base[3] = 0
    x = np.tile(base, (30, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = VectorIndex.create(rows, str(tmp_path / "i"), "i", metric=metric, shard_rows=200)
    asked = rows.where("vec_id < 20").toDF("qid", "qvec")
    for allowed, keys in ((None, np.arange(600)), (rows.where("vec_id % 7 = 1"), np.arange(1, 600, 7))):
        found = {i: [] for i in range(20)}
        for r in index.join(asked, 12, allowed=allowed).orderBy("qid", "rank").collect():
            found[r.qid].append((r.key, round(r.dist, 5)))
        for i in range(20):
            with np.errstate(invalid="ignore"):
                d = exact_distances(metric, np.broadcast_to(x[i], x[keys].shape), x[keys])
            d = np.where(np.isnan(d), 1.0, d)
            best = np.lexsort((keys, d))[:12]
            assert found[i] == [(int(keys[n]), round(float(d[n]), 5)) for n in best]
