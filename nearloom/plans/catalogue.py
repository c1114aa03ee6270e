"""Every query of the engine by name, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import knn as exact
from nearloom.operators import knn_join as joins
from nearloom.operators import rabitq

Query = Callable[[SparkSession, str], DataFrame]

DIMS = 64
_SPARK: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_E = "embedding::DOUBLE[]"
_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DIST = {"l2sq": "list_distance", "cosine": "list_cosine_distance", "ip": "list_negative_inner_product"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the query vector of most queries."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _SPARK[name] = query
    if sql is not None:
        _SQL[name] = sql


def _rounded(df: DataFrame, *columns: str, dist: str = "dist") -> DataFrame:
    return df.select(*columns, F.round(dist, 6).alias("dist"))


def _all(function: Callable) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(first_vector(spark, sf_dir).toDF("q")))
        return rows.select("vec_id", F.round(function(F.col("embedding"), F.col("q"), DIMS), 6).alias("value"))

    return f


for _name, _function, _sql in (
    ("dist_l2", distances.l2_distance, f"list_distance({_E}, {_Q0})"),
    ("dist_cosine", distances.cosine_distance, f"list_cosine_distance({_E}, {_Q0})"),
    ("dist_ip", distances.negative_inner_product, f"list_negative_inner_product({_E}, {_Q0})"),
    ("sim_cosine", distances.cosine_similarity, f"list_cosine_similarity({_E}, {_Q0})"),
    ("sim_ip", distances.inner_product, f"list_inner_product({_E}, {_Q0})"),
    ("cosine_rewrite", lambda a, b, d: F.lit(1.0) - distances.cosine_similarity(a, b, d), f"list_cosine_distance({_E}, {_Q0})"),
):
    _add(_name, _all(_function), f"SELECT vec_id, round({_sql}, 6) AS value FROM embeddings")


def _top(metric: str = "l2sq", where: str | None = None, k: int = 10, offset: int = 0) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = exact.knn(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), k, metric, where=where, offset=offset, dims=DIMS)
        return _rounded(found, "vec_id", "label")

    return f


def _top_sql(metric: str = "l2sq", where: str | None = None, k: int = 10, offset: int = 0) -> str:
    d = f"{_DIST[metric]}({_E}, {_Q0})"
    return f"SELECT vec_id, label, round({d}, 6) AS dist FROM embeddings {'WHERE ' + where if where else ''} ORDER BY {d}, vec_id LIMIT {k} OFFSET {offset}"


for _name, _options in {
    "knn_l2": {},
    "knn_cosine": {"metric": "cosine"},
    "knn_ip": {"metric": "ip"},
    "knn_filtered_eq": {"where": "label = 3"},
    "knn_filtered_range": {"where": "vec_id >= 100 AND vec_id < 200"},
    "knn_filtered_in": {"where": "label IN (1, 4, 7)"},
    "knn_filtered_and": {"where": "label > 2 AND vec_id % 2 = 0"},
    "knn_filtered_all": {"where": "vec_id >= 0"},
    "knn_filtered_most": {"where": "label < 7"},
    "knn_filtered_none": {"where": "label = 999"},
    "knn_filtered_single": {"where": "vec_id = 17"},
    "knn_residual_filter": {"where": "vec_id % 3 = 0"},
    "knn_offset": {"offset": 5},
}.items():
    _add(_name, _top(**_options), _top_sql(**_options))


def _other_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = table(spark, sf_dir, "embeddings").where("label = 5").orderBy("vec_id").limit(1).select("embedding")
    return _rounded(exact.knn(table(spark, sf_dir, "embeddings"), query, 10, "cosine", dims=DIMS), "vec_id")


_Q5 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE label = 5 ORDER BY vec_id LIMIT 1)"
_add("knn_subquery_vector", _other_vector, f"SELECT vec_id, round(list_cosine_distance({_E}, {_Q5}), 6) AS dist FROM embeddings ORDER BY list_cosine_distance({_E}, {_Q5}), vec_id LIMIT 10")


def _meta(name: str, key: str, columns: tuple[str, ...], where: str | None = None, k: int = 10, order: tuple[str, ...] = (), metric: str = "l2sq") -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, m = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, name_of)
        found = exact.knn_with_metadata(e, m, first_vector(spark, sf_dir), k, F.col("vec_id") == F.col(key), metric, where=where, order=order, dims=DIMS)
        return _rounded(found, "vec_id", *columns)

    name_of = {"doc_id": "labels" if columns and columns[0] in ("quality", "toxic") else "documents", "p_partkey": "part", "o_custkey": "orders", "c_custkey": "customer"}[key]
    d = f"{_DIST[metric]}({_E}, {_Q0})"
    tail = "".join(f", {c}" for c in order)
    _add(name, f, f"SELECT vec_id{''.join(', ' + c for c in columns)}, round({d}, 6) AS dist FROM embeddings JOIN {name_of} ON vec_id = {key} {'WHERE ' + where if where else ''} ORDER BY {d}, vec_id{tail} LIMIT {k}")


_meta("meta_join_doc_lang", "doc_id", ("lang",), "lang = 'en'")
_meta("meta_join_doc_source", "doc_id", ("source", "lang"), "lang = 'de' AND source <> 'src0' AND label < 8", metric="cosine")
_meta("meta_join_labels", "doc_id", ("quality", "toxic"), "quality = 1 AND label >= 2")
_meta("meta_join_part_brand", "p_partkey", ("p_brand",), "p_size BETWEEN 10 AND 30 AND p_name IS NOT NULL", metric="ip")
_meta("meta_join_customer", "c_custkey", ("c_name", "c_mktsegment"), "c_mktsegment LIKE 'B%' AND vec_id % 2 = 1")
_meta("meta_join_dupes", "o_custkey", ("o_orderkey",), None, 25, ("o_orderkey",))
_meta("meta_join_empty", "doc_id", ("lang",), "lang = 'zz'")
_meta("meta_join_nofilter", "p_partkey", ("p_type",))
_meta("meta_join_k_gt_matches", "doc_id", ("lang",), "vec_id < 7", 50)


def _with_dist(spark: SparkSession, sf_dir: str, metric: str = "l2sq") -> DataFrame:
    return exact.with_distance(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), metric, dims=DIMS)


def _list(where: str | None, k: int) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _with_dist(spark, sf_dir)
        listed = exact.min_by_k(rows if where is None else rows.where(where), F.col("vec_id"), F.col("dist"), k)
        return listed.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))

    return f


def _list_sql(where: str | None, k: int) -> str:
    return f"SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY d, vec_id) AS items FROM (SELECT vec_id, list_distance({_E}, {_Q0}) AS d FROM embeddings {'WHERE ' + where if where else ''} ORDER BY d, vec_id LIMIT {k})"


for _name, _where, _k in (("minby_k", None, 5), ("minby_k_filtered", "label = 2", 4), ("minby_k_empty", "label = 999", 3), ("minby_scalar", None, 1)):
    _add(_name, _list(_where, _k), _list_sql(_where, _k))

_GROUPS = {
    "grouped_minby_k1": ({"g": ("label", "label")}, 1, None),
    "grouped_minby_k3": ({"g": ("label", "label")}, 3, None),
    "grouped_minby_k5": ({"g": ("label", "label")}, 5, None),
    "grouped_minby_where": ({"g": ("label", "label")}, 3, "vec_id > 100 AND label <> 4"),
    "grouped_minby_expr_key": ({"g": ("label % 3", "label % 3")}, 4, None),
    "grouped_minby_multi_key": ({"g": ("label", "label"), "h": ("vec_id % 2", "vec_id % 2")}, 2, None),
    "grouped_minby_string_key": ({"g": ("concat('l', cast(label as string))", "concat('l', label)")}, 3, None),
    "grouped_minby_large_k": ({"g": ("vec_id % 250", "vec_id % 250")}, 20, None),
    "grouped_minby_null_key": ({"g": ("nullif(label, 3)", "nullif(label, 3)")}, 3, None),
    "grouped_minby_empty": ({"g": ("label", "label")}, 3, "label = 999"),
}


def _grouped(groups: dict, k: int, where: str | None) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _with_dist(spark, sf_dir)
        rows = rows if where is None else rows.where(where)
        listed = exact.grouped_min_by_k(rows, {n: F.expr(e) for n, (e, _) in groups.items()}, F.col("vec_id"), F.col("dist"), k)
        return listed.select(*groups, F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))

    return f


for _name, (_groups, _k, _where) in _GROUPS.items():
    _keys = ", ".join(f"{e} AS {n}" for n, (_, e) in _groups.items())
    _names = ", ".join(_groups)
    _add(
        _name,
        _grouped(_groups, _k, _where),
        f"WITH r AS (SELECT {_keys}, vec_id, list_distance({_E}, {_Q0}) AS d FROM embeddings {'WHERE ' + _where if _where else ''}), "
        f"n AS (SELECT *, row_number() OVER (PARTITION BY {_names} ORDER BY d, vec_id) AS rn FROM r) "
        f"SELECT {_names}, string_agg(vec_id::VARCHAR, ',' ORDER BY rn) AS items FROM n WHERE rn <= {_k} GROUP BY {_names}",
    )


def _having(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = exact.grouped_min_by_k(_with_dist(spark, sf_dir), {"g": F.col("label")}, F.col("vec_id"), F.col("dist"), 3)
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("g")).count().where("count > 50")
    return listed.join(sizes, "g", "left_semi").select("g", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


_add("grouped_minby_having", _having, f"WITH n AS (SELECT label AS g, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_distance({_E}, {_Q0}), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS c FROM embeddings) SELECT g, string_agg(vec_id::VARCHAR, ',' ORDER BY rn) AS items FROM n WHERE rn <= 3 AND c > 50 GROUP BY g")


def _join(k: int, metric: str = "l2sq", where: str | None = None) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        queries = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
        found = joins.knn_join(queries, e, k, metric, where=where)
        return found.select("qid", F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))

    return f


def _join_sql(k: int, metric: str = "l2sq", where: str | None = None, vec: str = _E, asked: str = "true") -> str:
    d = f"{_DIST[metric]}(e.{vec}, q.{vec})"
    return (
        f"WITH t AS (SELECT * FROM embeddings), q AS (SELECT * FROM t WHERE {asked}), r AS (SELECT q.vec_id AS qid, e.vec_id, {d} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, e.vec_id) AS rank "
        f"FROM q, t e {'WHERE e.' + where if where else ''}) SELECT qid, vec_id, round(d, 6) AS dist, rank FROM r WHERE rank <= {k}"
    )


for _name, _options in {
    "knn_join_k1": {"k": 1},
    "knn_join_k3": {"k": 3},
    "knn_join_k10": {"k": 10},
    "knn_join_cosine": {"k": 3, "metric": "cosine"},
    "knn_join_ip": {"k": 3, "metric": "ip"},
    "knn_join_where": {"k": 3, "where": "label < 7"},
    "knn_join_all": {"k": 5},
}.items():
    _add(_name, _join(**_options), _join_sql(**_options))


def _join_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors far from the origin beside near copies of themselves, where a matrix product alone is too coarse."""
    e = table(spark, sf_dir, "embeddings")
    far = lambda by: F.transform("embedding", lambda x: (x * 0.001 + 1000 + by).cast("float"))
    rows = e.select("vec_id", far(0.0).alias("embedding")).unionByName(e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), far(0.0625).alias("embedding")))
    found = joins.knn_join(rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), rows, 2)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), F.round("dist", 4).alias("dist"))


_FAR = "list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 0.001 + 1000 + {} AS FLOAT))"
_add(
    "knn_join_far",
    _join_far,
    f"WITH t AS (SELECT vec_id, {_FAR.format('0.0')}::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, {_FAR.format('0.0625')}::DOUBLE[] FROM embeddings), "
    "r AS (SELECT q.vec_id AS qid, list_distance(e.v, q.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.v, q.v), e.vec_id) AS rank FROM t q, t e) SELECT qid, rank, round(d, 4) AS dist FROM r WHERE rank <= 2",
)


def _join_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _join(4)(spark, sf_dir)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string"))
    return ranked.groupBy("qid").agg(F.array_join(listed, ",").alias("items"))


_add("knn_join_grouped_list", _join_list, f"SELECT qid, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS items FROM ({_join_sql(4)}) GROUP BY qid")
#: What a correlated subquery with a limit asks for; as SQL it would be planned as a cartesian product.
_add("knn_join_lateral", lambda s, d: _join(3)(s, d).drop("rank"), f"SELECT qid, vec_id, dist FROM ({_join_sql(3)})")


def _macro(metric: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        rows = joins.vss_join(e, e, "embedding", "embedding", 3, metric)
        return rows.select(F.round("score", 6).alias("score"), F.col("left_tbl.vec_id").alias("left_id"), F.col("right_tbl.vec_id").alias("right_id"), F.col("right_tbl.label").alias("right_label"))

    return f


def _macro_sql(metric: str) -> str:
    d = f"{_DIST[metric]}(e.{_E}, q.{_E})"
    score = {"l2sq": "d", "cosine": "1 - d", "ip": "-d"}[metric]
    return f"WITH r AS (SELECT q.vec_id AS left_id, e.vec_id AS right_id, e.label AS right_label, {d} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, e.vec_id) AS rn FROM embeddings q, embeddings e) SELECT round({score}, 6) AS score, left_id, right_id, right_label, rn FROM r WHERE rn <= 3"


def _match(metric: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        rows = joins.vss_match(e.select("vec_id", "embedding"), e, "embedding", "embedding", 3, metric)
        ids = F.transform("matches", lambda m: m["row"]["vec_id"].cast("string"))
        return rows.select("vec_id", F.array_join(ids, ",").alias("items"), F.round(F.element_at("matches", 3)["score"], 6).alias("worst"))

    return f


for _name, _metric in (("l2", "l2sq"), ("cosine", "cosine"), ("ip", "ip")):
    _add(f"vss_join_{_name}", _macro(_metric), f"SELECT score, left_id, right_id, right_label FROM ({_macro_sql(_metric)})")
    _add(f"vss_match_{_name}", _match(_metric), f"SELECT left_id AS vec_id, string_agg(right_id::VARCHAR, ',' ORDER BY rn) AS items, max(score) FILTER (WHERE rn = 3) AS worst FROM ({_macro_sql(_metric)}) GROUP BY left_id")


def _centroid(metric: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = rabitq.centroid(table(spark, sf_dir, "embeddings"), DIMS, metric)
        return c.select(F.posexplode("centroid").alias("pos", "value")).select(F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))

    return f


_MEAN = f"SELECT sqrt(list_inner_product({_E}, {_E})) AS norm, vec_id, unnest({_E}) AS x, unnest(range(64)) AS pos FROM embeddings"
_add("rabitq_centroid", _centroid("l2sq"), f"SELECT pos, round(avg(x), 6) AS value FROM ({_MEAN}) GROUP BY pos")
_add("rabitq_centroid_cosine", _centroid("cosine"), f"SELECT pos, round(avg(x / norm), 6) AS value FROM ({_MEAN}) GROUP BY pos")


def center_of(spark: SparkSession, sf_dir: str, metric: str = "l2sq") -> list[float]:
    return rabitq.centroid(table(spark, sf_dir, "embeddings"), DIMS, metric).first().centroid


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = rabitq.with_code(table(spark, sf_dir, "embeddings"), center_of(spark, sf_dir))
    return coded.select("vec_id", F.bit_count(F.col("code.bits")[0]).cast("long").alias("ones"), F.col("code.norm").cast("double").alias("norm"), F.col("code.vdot").cast("double").alias("vdot"))


_add(
    "rabitq_code",
    lambda s, d: _codes(s, d).select("vec_id", F.round("norm", 4).alias("norm"), F.round("vdot", 4).alias("vdot")),
    f"WITH m AS (SELECT pos, avg(x) AS c FROM ({_MEAN}) GROUP BY pos), r AS (SELECT vec_id, x - c AS r FROM ({_MEAN}) JOIN m USING (pos)) SELECT vec_id, round(CAST(CAST(sqrt(sum(r * r)) AS FLOAT) AS DOUBLE), 4) AS norm, round(CAST(CAST(sum(abs(r)) / sqrt(sum(r * r)) / 8.0 AS FLOAT) AS DOUBLE), 4) AS vdot FROM r GROUP BY vec_id",
)
_add("rabitq_bits_popcount", lambda s, d: _codes(s, d).select("vec_id", "ones"), f"WITH m AS (SELECT pos, avg(x) AS c FROM ({_MEAN}) GROUP BY pos) SELECT vec_id, count(*) FILTER (WHERE x - c >= 0) AS ones FROM ({_MEAN}) JOIN m USING (pos) GROUP BY vec_id")


ASKED = "vec_id % 100 = 0"  # the queries of a search: every row whose id is divisible by 100, against all rows


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(ASKED).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _quantized(metric: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rabitq.search_join(asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, center_of(spark, sf_dir, metric), metric, oversample=10)
        return found.select("qid", F.col("key").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))

    return f


for _name, _metric in (("rabitq_search", "l2sq"), ("rabitq_search_cosine", "cosine"), ("rabitq_search_ip", "ip")):
    _add(_name, _quantized(_metric), _join_sql(10, _metric, asked=ASKED))


def _recall_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between consecutive results: ``lead`` over an explicit order."""
    found = _top()(spark, sf_dir)
    over = Window.orderBy("dist", "vec_id")
    return found.select("vec_id", F.round(F.lead("dist").over(over) - F.col("dist"), 5).alias("gap"))


_add("knn_gaps", _recall_gap, f"SELECT vec_id, round(lead(dist) OVER (ORDER BY dist, vec_id) - dist, 5) AS gap FROM ({_top_sql()})")


def _exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("vec_id"))
    return _rounded(exact.knn(e.join(d, "vec_id", "left_semi"), first_vector(spark, sf_dir), 10, dims=DIMS), "vec_id")


_add("knn_semi_join", _exists, f"SELECT vec_id, round(list_distance({_E}, {_Q0}), 6) AS dist FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY list_distance({_E}, {_Q0}), vec_id LIMIT 10")


def _anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return _rounded(exact.knn(e.join(d, "vec_id", "left_anti"), first_vector(spark, sf_dir), 10, dims=DIMS), "vec_id")


for _name, _where in (("knn_not_exists", "NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)"), ("knn_not_in", "vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")):
    _add(_name, _anti, f"SELECT vec_id, round(list_distance({_E}, {_Q0}), 6) AS dist FROM embeddings WHERE {_where} ORDER BY list_distance({_E}, {_Q0}), vec_id LIMIT 10")


def _group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replaying grouped top-k results takes: distinct counts, filtered counts, bool_and, max_by."""
    rows = _with_dist(spark, sf_dir)
    return rows.groupBy("label").agg(
        F.countDistinct("vec_id").alias("ids"), F.count(F.when(F.col("vec_id") % 2 == 0, 1)).alias("even"), F.bool_and(F.col("dist") >= 0).alias("sound"),
        F.max_by("vec_id", F.struct("dist", "vec_id")).alias("farthest"), F.min_by("vec_id", F.struct("dist", (-F.col("vec_id")).alias("n"))).alias("nearest"),
    )


_add(
    "grouped_checks",
    _group_checks,
    f"SELECT label, count(DISTINCT vec_id) AS ids, count(*) FILTER (WHERE vec_id % 2 = 0) AS even, bool_and(d >= 0) AS sound, arg_max(vec_id, (d, vec_id)) AS farthest, arg_min(vec_id, (d, -vec_id)) AS nearest FROM (SELECT *, list_distance({_E}, {_Q0}) AS d FROM embeddings) GROUP BY label",
)


def _max_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = exact.grouped_min_by_k(_with_dist(spark, sf_dir), {"g": F.col("label")}, F.col("vec_id"), -F.col("dist"), 3)
    return listed.select("g", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


_add("grouped_maxby_k3", _max_by_k, f"WITH n AS (SELECT label AS g, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_distance({_E}, {_Q0}) DESC, vec_id) AS rn FROM embeddings) SELECT g, string_agg(vec_id::VARCHAR, ',' ORDER BY rn) AS items FROM n WHERE rn <= 3 GROUP BY g")


def queries() -> dict[str, Query]:
    from nearloom.plans import approximate

    return _SPARK | approximate.queries()


def oracle_sql() -> dict[str, str]:
    from nearloom.plans import approximate

    return _SQL | approximate.oracle_sql()
