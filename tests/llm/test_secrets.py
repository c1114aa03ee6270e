"""Secret scans: candidates, positions and held-out accuracy of the forest."""

import numpy as np
import regex
from pyspark.sql import functions as F

from nearloom.llm import secretscan as s


def test_scan(spark, docs):
    forest = s.fit(spark)
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'Some words token = "{key}" and more', "card 2669109448945250 on", f"commit {key} by me", None, "", "x" * 400_000 + " " + f"api_key: '{key}'", f'a token="{key}" b token="{key}"', "eneauouonelleenmentaiou"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("runs", F.lit(1))
    got = {r.doc_id: r for r in s.scan(df, forest).collect()}
    assert [got[i].n_findings for i in range(8)] == [1, 0, 0, 0, 0, 1, 2, 0]
    for i in (0, 5, 6):
        for f in got[i].findings:
            assert texts[i][f.start : f.start + f.length] == key
    assert [got[i].n_candidates for i in range(8)] == [len(regex.findall(s.CANDIDATE, t or "")) for t in texts]
    assert s.scan(docs, forest).count() == docs.count() and s.scan(docs.limit(0), forest).count() == 0


def test_held_out_accuracy(spark):
    rows = spark.createDataFrame(s.labelled_findings(3000), "run string, l string, r string, path string, label int")
    named = [c.alias(n) for c, n in zip(s.features(F.col("run"), F.col("l"), F.col("r"), F.col("path")), s.NAMES, strict=True)]
    scored = rows.select(*named, "label").withColumn("p", F.lit(0.0))
    data = np.array([tuple(r)[:-1] for r in scored.collect()], float)
    forest = s.train(data[:2000, :-1], data[:2000, -1])
    p = rows.select(*named, "label").withColumn("p", s.as_column(forest, F.col)).collect()
    right = np.mean([(r.p >= 0.5) == r.label for r in p[2000:]])
    assert right > 0.93


def test_recall_by_kind(spark):
    kinds = []
    rows = s.labelled_findings(3000, seed=77, kinds=kinds)
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, run string, l string, r string, source string, label int")
    texts = found.select("doc_id", F.concat("l", "run", "r").alias("text"), "source")
    flagged = {r.doc_id for r in s.scan(texts, s.fit(spark)).where("n_findings > 0").collect()}
    share = {}
    for i, (k, r) in enumerate(zip(kinds, rows, strict=True)):
        share.setdefault((r[-1], k), []).append(i in flagged)
    share = {k: round(float(np.mean(v)), 2) for k, v in share.items()}
    print(share)
    assert all(v >= 0.8 for (label, _), v in share.items() if label) and all(v <= 0.2 for (label, _), v in share.items() if not label)


def test_assigned_values_of_any_length_and_sign(spark):
    texts = ['password = "Tr0ub4dor&3!"', "the password: required here", "db_password=hunter2!X9 # x", "passwords are fine", 'secret: "QmFzZVNpeHR5Rm91cktleQ"', "token => getToken()"]
    got = s.scan(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"), s.fit(spark)).orderBy("doc_id").collect()
    assert [r.n_candidates for r in got] == [1, 1, 1, 0, 1, 1] and [r.n_findings for r in got][3] == 0 and got[0].n_findings == 1 and got[1].n_findings == 0
    assert texts[0][got[0].findings[0].start :][: got[0].findings[0].length] == "Tr0ub4dor&3!"
