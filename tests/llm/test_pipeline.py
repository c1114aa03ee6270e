"""The pipeline, stage by stage, against brute force on its own input."""

import corpus_pipeline as pipeline
from nearloom.llm import toxicity
from nearloom.llm.common import table
from tests.compare import spark_rows, sql_rows
from tests.llm import brute
from tests.llm.test_operators import family


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == pipeline.COLUMNS
            kept = {r.doc_id: r.text for r in after.collect()}
        if i == 0:
            scores = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).where("predicted = 0")
            assert set(kept) == {r.doc_id for r in scores.collect()} and 0.8 * len(before) < len(kept) < len(before)
        if i == 1:
            want = {a: n for a, _, n, _ in brute.line_dedup(before)}
            lines = {a: len((t or "").split("\n")) for a, t in before}
            assert set(kept) == set(want) and all(len(kept[a].split("\n")) == max(1, lines[a] - want[a]) for a in kept)
        if i == 2:
            want = brute.components(before, 5)
            assert set(kept) == {a for a, b in want.items() if a == b}
        if i == 3:
            items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            assert set(kept) == {r[0] for r in brute.contamination(before, items) if not r[5]}
        if i == 4:
            assert {r.doc_id for r in after.collect()} == {a for a, _ in before}
        docs = after


def test_queries_equal_their_sql(spark, sf_dir, duck):
    from nearloom.llm import registry

    for name, sql in registry.oracle_sql().items():
        assert spark_rows(registry.queries()[name](spark, sf_dir)) == sql_rows(duck, sql), name


def test_stages_on_awkward_rows(spark, sf_dir, docs, awkward):
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    more = [(None, f"before {item} after"), (None, None), (500, item), (500, "clean " + awkward[9][1][:200])]
    rows = docs.select(*pipeline.COLUMNS, "h1").unionByName(spark.createDataFrame([(i, t, None, None, None, "x") for i, t in more], "doc_id long, text string, lang string, source string, n_chars long, h1 string"))
    every = [*awkward, *more]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = [r[:2] for r, c in zip(every, brute.contamination(every, items), strict=True) if not c[5]]
    out = pipeline.drop_contaminated(spark, rows, sf_dir)
    assert out.columns == pipeline.COLUMNS
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, clean))
    groups = brute.components([(i, t) for i, t in every if i is not None], 5)
    left = [(i, t) for i, t in every if i is None or groups[i] == i]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, rows, sf_dir).collect()))) == sorted(map(repr, left))
    lines = pipeline.drop_lines(spark, rows, sf_dir)
    assert lines.count() == len(every) and all(r.n_chars == len(r.text or "") for r in lines.collect())
    assert pipeline.drop_toxic(spark, rows, sf_dir).columns == pipeline.COLUMNS
    assert {r.doc_id for r in pipeline.pack(spark, rows, sf_dir).collect()} == {i for i, _ in every}
    assert all(f(spark, rows.limit(0), sf_dir).count() == 0 for _, f in pipeline.STAGES)


def test_near_copies_in_a_large_group_of_versions_go(spark, sf_dir):
    rows, pairs = family(3, 500, 10, step=5)
    texts = dict(rows)
    for a, b in pairs:
        x, y = (brute.shingles(texts[i], 5) for i in (a, b))
        assert 100 * len(x & y) >= 80 * len(x | y)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = {r.doc_id for r in pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id").collect()}
    assert left == {i for i, _ in rows} - {b for _, b in pairs}
