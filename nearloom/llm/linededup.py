"""Dropping lines that recur across documents.

Lines are normalised (white space stripped at both ends, A-Z lower-cased) and hashed to 128
bits; a line of at least ``min_chars`` code points found in at least ``min_docs`` documents
loses all its occurrences but those in the document with the largest id.  The rest is put
together again by position.

Plan: each document gives each of its keys once (so the counts are of documents), one partial
and one final aggregate count them, the frequent keys join back to their documents (a sort-merge
join that AQE can split at a frequent key), and each document gets the set of its keys to drop.

Defined results: a null or empty text is one empty line; every row is a document, so repeated
rows count; a null id is smaller than any other; equal largest ids all keep the line; an empty
table gives an empty result; other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.llm.common import FLUSH_BYTES, binary_list, joined_row, split_row

_SPACE = b" \t\n\r\x0b\x0c"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line of a UTF-8 text: the 128-bit hash of its key, or None if it is too short."""
    keys = [k.strip(_SPACE) for k in text.lower().split(b"\n")]  # bytes.lower() is A-Z only
    digest = xxhash.xxh3_128_digest
    return [digest(k) if len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars) else None for k in keys]


def _emit(min_chars: int):
    schema = pa.schema([("__id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{k for k in line_keys(t, min_chars) if k} for t in binary_list(batch.column(1))]
            hashes = np.frombuffer(b"".join(k for ks in found for k in sorted(ks)), "<i8").reshape(-1, 2)
            index = np.repeat(np.arange(len(found)), [len(ks) for ks in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], schema=schema)

    return f


def _reassemble(min_chars: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * FLUSH_BYTES // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts, total, gone = [], [], []
                drops = batch.column(2)
                for text, drop in zip(binary_list(batch.column(1)), drops, strict=True):
                    lines = text.split(b"\n")
                    total.append(len(lines))
                    drop = drop.as_py()
                    if drop:
                        drop = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in ((x["h1"], x["h2"]) for x in drop)}
                        kept = [x for x, k in zip(lines, line_keys(text, min_chars), strict=True) if k not in drop]
                        gone.append(len(lines) - len(kept))
                        texts.append(b"\n".join(kept))
                    else:
                        gone.append(0)
                        texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), batch.column(3), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["__text", "__rest", "__lines", "__dropped"])

    return f


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines dropped from ``text_col``, and columns ``n_lines`` and ``n_dropped``."""
    rows, columns = split_row(docs, id_col, text_col)
    rows = rows.withColumn("__id", F.col("__id").cast("long"))
    held = rows.select("__id", "__text").mapInArrow(_emit(min_chars), "__id long, h1 long, h2 long")
    frequent = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    losing = held.join(frequent, ["h1", "h2"]).where(~F.col("__id").eqNullSafe(F.col("keeper")))
    drops = losing.groupBy(F.col("__id").alias("__drop_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("__drops"))
    whole = rows.join(drops, F.col("__id").eqNullSafe(F.col("__drop_id")), "left").select("__id", "__text", "__drops", "__rest")
    schema = T.StructType([T.StructField("__text", T.StringType()), T.StructField("__rest", rows.schema["__rest"].dataType), T.StructField("__lines", T.LongType()), T.StructField("__dropped", T.LongType())])
    done = whole.mapInArrow(_reassemble(min_chars), schema)
    return joined_row(done, docs.columns, text_col, {"n_lines": "__lines", "n_dropped": "__dropped"})
