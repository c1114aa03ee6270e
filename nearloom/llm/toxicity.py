"""Toxicity scores of whole texts, from overlapping windows read by a recurrent classifier.

The classifier (``gru``) is trained by tasks from a bounded sample of labelled rows: at most
``POSITIVE`` and ``NEGATIVE`` documents, chosen by a hash of their ids, which pass through the driver.  Training and scoring read
every window of every text they are given.  A logistic head turns a document's greatest window and
mean window into its score.  It is fitted on what two classifiers, each trained on one half of the
sample, say of the other half, weighted back to the labels' own shares; the classifier that scores
is trained on all of the sample.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out of all fitting.  Scores use the text only.

Defined results: null and empty texts are one window without words and get a score like any
other; repeated rows get equal scores up to the rounding of single precision; of repeated labels the greatest counts, null ones do not;
without labels of both kinds every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.llm import gru
from nearloom.llm.common import FLUSH_BYTES, binary_list, checkpointed, joined_row, release, releasing, split_row

POSITIVE, NEGATIVE = 1500, 2500
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(table: gru.WordTable, texts: list[bytes]) -> np.ndarray:
    """For each text: its greatest window logit, and the logit of its mean window probability."""
    buffer, starts, lengths, counts = gru.units(texts)
    first, length, text = gru.windows(counts)
    logit = gru.window_logits(table, table.lookup(buffer, starts, lengths), first, length).astype(np.float64)
    at = np.searchsorted(text, np.arange(len(texts)))
    p = np.clip(np.add.reduceat(1 / (1 + np.exp(-logit)), at) / np.bincount(text), 1e-6, 1 - 1e-6)
    release()
    return np.stack([np.maximum.reduceat(logit, at), np.log(p / (1 - p))], 1)


def _slices(batch: pa.RecordBatch, size: int = FLUSH_BYTES // 16) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(c))
        change = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * c)
        c += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return c


def _taught(texts: list[bytes], y: np.ndarray, half: np.ndarray, which: int) -> tuple | dict | None:
    """0 or 1: which texts are in that half, and their features by what the other half has taught; 2: the weights that all teach."""
    if which == 2:
        return gru.train(texts, y)
    train, judge = np.flatnonzero(half != which), np.flatnonzero(half == which)
    if len(set(y[train].tolist())) < 2 or not len(judge):
        return None
    words = gru.WordTable(gru.train([texts[i] for i in train], y[train], steps=200))
    return judge, np.concatenate([features(words, [texts[i] for i in judge[a : a + 64]]) for a in range(0, len(judge), 64)])


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, or None where labels of both kinds are missing."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    have = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = checkpointed(have)
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, POSITIVE), (0, NEGATIVE))]
    chosen = chosen[0].unionByName(chosen[1])  # at most POSITIVE + NEGATIVE ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, y = binary_list(rows.column("text")), rows.column("toxic").to_numpy()
    half = np.array([zlib.crc32(b"half %d" % i) % 2 for i in rows.column("doc_id").to_pylist()])
    del rows
    context = docs.sparkSession.sparkContext
    sample = context.broadcast((texts, y, half))

    def part(which: int) -> tuple | dict | None:
        try:
            return _taught(*sample.value, which)
        finally:
            release()

    del texts
    *judged, weights = context.parallelize(range(3), 3).map(part).collect()
    sample.destroy()
    x = np.zeros((len(y), 2))
    for judge, found in (j for j in judged if j is not None):
        x[judge] = found
    weight = np.where(y > 0, share[1] / y.sum(), share[0] / (1 - y).sum())
    head = _logistic(x, y, weight * len(y) / weight.sum())
    return {"words": context.broadcast(weights), "head": head}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns ``score`` and ``predicted``."""
    rows, _ = split_row(docs, id_col, text_col)
    if model is None:
        return joined_row(rows.withColumn("__score", F.lit(0.0)).withColumn("__predicted", F.lit(0)), docs.columns, text_col, {"score": "__score", "predicted": "__predicted"})
    words, head = model["words"], model["head"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gru.WordTable(words.value)
        for batch in (s for b in batches for s in _slices(b)):
            p = 1 / (1 + np.exp(-np.clip(features(table, binary_list(batch.column(0))) @ head[:-1] + head[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["__text", "__rest", "__score", "__predicted"])

    schema = T.StructType([T.StructField("__text", T.StringType()), T.StructField("__rest", rows.schema["__rest"].dataType), T.StructField("__score", T.DoubleType()), T.StructField("__predicted", T.IntegerType())])
    done = rows.select("__text", "__rest").mapInArrow(releasing(f), schema)
    return joined_row(done, docs.columns, text_col, {"score": "__score", "predicted": "__predicted"})

