"""One-bit codes of vectors: sign of each dimension around a centroid, a norm and a correction.

A code holds bits for ``x - centroid`` (``x`` normalised for cosine), its norm, and the mean
absolute coordinate of its direction times sqrt(D).  Two codes estimate their squared distance by
the bits in which they differ.  Search takes ``k * oversample`` rows by the estimate; the exact
distance of the k-th best of them is a limit, and every row whose code allows a distance within the
limit is ranked by its exact distance.  The rows are those of an exact search, whatever the oversample.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators.knn import knn
from nearloom.operators.knn_join import ASKED_TILE, DEALT, FOUND, ROW_TILE, Nearest, Screen, asked_of, in_blocks, ranked, vectors_of

CODE = "bits array<bigint>, norm float, vdot float"


def bytes_per_vector(dims: int, quantization: str = "rabitq") -> int:
    """Bits in whole bytes and two floats; or four bytes a dimension."""
    return -(-dims // 8) + 8 if quantization == "rabitq" else 4 * dims


def centroid(df: DataFrame, dims: int, metric: str = "l2sq", vec: str = "embedding") -> DataFrame:
    """One row, ``centroid array<double>``: the mean of the vectors (of their directions, for cosine).

    One partial aggregate of the whole vector; without vectors, zeros.
    """
    x = F.transform(vec, lambda v: v.cast("double"))
    if distances.metric_name(metric) == "cosine":
        norm = F.sqrt(distances.inner_product(F.col(vec), F.col(vec)))
        x = F.when(norm == 0, F.array_repeat(F.lit(0.0), dims)).otherwise(F.transform(vec, lambda v: v.cast("double") / norm))
    zeros = df.sparkSession.range(1).select(F.array_repeat(F.lit(0.0), dims).alias("__x"))  # the summary of nothing is an error
    rows = df.where(F.col(vec).isNotNull()).select(x.alias("__x")).unionByName(zeros)
    total, n = vector_to_array(Summarizer.sum(array_to_vector("__x"))), F.count(F.lit(1)) - 1
    return rows.agg(total.alias("s"), n.alias("n")).select(F.transform("s", lambda v: v / F.greatest(F.col("n"), F.lit(1))).alias("centroid"))


def encode(x: np.ndarray, center: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [n, ceil(D / 64)], norms and corrections of vectors [n, D]."""
    x = x.astype(np.float64)
    if metric == "cosine":
        length = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    rest = x - center
    norm = np.sqrt((rest * rest).sum(1))
    bits = rest >= 0
    dims = x.shape[1]
    vdot = np.divide(np.abs(rest).sum(1), norm * np.sqrt(dims), out=np.zeros_like(norm), where=norm > 0)
    padded = np.zeros((len(x), -(-dims // 64) * 64), bool)
    padded[:, :dims] = bits
    words = np.packbits(padded, axis=1, bitorder="little").view("<i8")
    return words, norm.astype(np.float32), vdot.astype(np.float32)


def with_code(df: DataFrame, center: Sequence[float], metric: str = "l2sq", vec: str = "embedding", name: str = "code") -> DataFrame:
    """``df`` with a struct (bits as 64-bit words, norm, vdot); built-in functions only."""
    dims = len(center)
    metric = distances.metric_name(metric)
    length = F.sqrt(distances.inner_product(F.col(vec), F.col(vec), dims))
    scale = F.when(length == 0, F.lit(0.0)).otherwise(F.lit(1.0) / length) if metric == "cosine" else F.lit(1.0)
    c = F.array(*[F.lit(float(v)) for v in center])
    rest = F.zip_with(F.col(vec), c, lambda x, m: x.cast("double") * F.col("__s") - m)
    rows = df.withColumn("__s", scale).withColumn("__rest", rest)
    norm = F.sqrt(F.aggregate("__rest", F.lit(0.0), lambda s, x: s + x * x))
    total = F.aggregate("__rest", F.lit(0.0), lambda s, x: s + F.abs(x))
    one = F.lit(1).cast("bigint")
    word = lambda w: F.aggregate(F.transform(F.slice("__rest", 64 * w + 1, F.lit(64)), lambda v, i: F.when(v >= 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))
    words = F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-dims // 64) - 1))), word)
    rows = rows.withColumn("__norm", norm)
    vdot = F.when(F.col("__norm") > 0, total / F.col("__norm") / F.lit(float(np.sqrt(dims)))).otherwise(F.lit(0.0))
    code = F.struct(words.alias("bits"), F.col("__norm").cast("float").alias("norm"), vdot.cast("float").alias("vdot"))
    return rows.withColumn(name, F.when(F.col(vec).isNotNull(), code)).drop("__s", "__rest", "__norm")


def hamming(a: Column, b: Column, words: int) -> Column:
    total = F.lit(0)
    for w in range(words):
        total = total + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))))
    return total


def estimated_l2_squared(a: Column, b: Column, dims: int) -> Column:
    """From two codes: |a|^2 + |b|^2 - 2 |a| |b| va vb (D - 2 differing bits) / D."""
    agree = F.lit(float(dims)) - 2 * hamming(a["bits"], b["bits"], -(-dims // 64))
    na, nb = a["norm"].cast("double"), b["norm"].cast("double")
    return na * na + nb * nb - 2 * na * nb * (a["vdot"].cast("double") * b["vdot"].cast("double") * agree / dims)


def least_distance(code: Column, query: Sequence[float], center: Sequence[float], metric: str) -> Column:
    """No row with this code is nearer to ``query``.

    With c the direction of the bits, a rest is ``norm * (vdot * c + sqrt(1 - vdot^2) * u)`` for some
    u at a right angle to c, so its product with q is at most that of ``vdot <c, q>`` and the length
    of q at a right angle to c (Cauchy-Schwarz).  The slack covers floats of the code.
    """
    q, m, dims = np.array(query, np.float32).astype(np.float64), np.array(center, np.float64), len(center)
    if metric == "cosine":
        length = np.sqrt(q @ q)
        q = q / length if length > 0 else q
    if metric != "ip":
        q = q - m
    size = float(q @ q)
    values = F.array(*[F.lit(float(v)) for v in q])
    bit = lambda i: F.getbit(F.get(code["bits"], F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))).cast("double")
    ones = F.aggregate(F.transform(values, lambda v, i: v * bit(i)), F.lit(0.0), lambda s, v: s + v)
    along = (2 * ones - F.lit(float(q.sum()))) / F.lit(float(np.sqrt(dims)))
    norm, vdot = code["norm"].cast("double"), code["vdot"].cast("double")
    across = F.sqrt(F.greatest(1 - vdot * vdot, F.lit(0.0)) + 1e-6) * F.sqrt(F.greatest(F.lit(size) - along * along, F.lit(0.0)) + 1e-12 * size)
    most = norm * (vdot * along + across) + 1e-6 * norm * float(np.sqrt(size))
    if metric == "ip":
        return -(most + float(m @ q)) - 1e-6 * float(np.abs(m) @ np.abs(q))
    squared = norm * norm * (1 - 1e-6) + size * (1 - 1e-6) - 2 * most
    return F.sqrt(F.greatest(squared, F.lit(0.0))) if metric == "l2sq" else squared / 2


def search(df: DataFrame, query: Sequence[float], k: int, center: Sequence[float], metric: str = "l2sq", key: str = "vec_id", vec: str = "embedding", oversample: int = 3, where: Column | str | None = None) -> DataFrame:
    """The ``k`` nearest; the ``k * oversample`` nearest by their codes only set the limit for the rest."""
    if oversample <= 0:
        raise ValueError("hnsw_rabitq_oversample must be greater than 0")
    metric, dims = distances.metric_name(metric), len(center)
    words, norm, vdot = encode(np.array([query], np.float32), np.array(center), metric)
    asked = F.struct(F.array(*[F.lit(int(w)).cast("bigint") for w in words[0]]).alias("bits"), F.lit(float(norm[0])).cast("float").alias("norm"), F.lit(float(vdot[0])).cast("float").alias("vdot"))
    rows = (df if where is None else df.where(where)).where(F.col(vec).isNotNull())
    coded = rows if "code" in df.columns else with_code(rows, center, metric, vec)
    near = coded.withColumn("__e", estimated_l2_squared(F.col("code"), asked, dims)).orderBy("__e", key).limit(k * oversample)
    first = knn(near.drop("__e", "code"), query, k, metric, key, vec)
    limit = first.agg(F.count(F.when(~F.isnan("dist"), 1)).alias("__n"), F.max("dist").alias("__limit"))  # one row
    within = (F.col("__n") < k) | (least_distance(F.col("code"), query, center, metric) <= F.col("__limit"))
    return knn(coded.crossJoin(F.broadcast(limit)).where(within).drop("__n", "__limit", "code"), query, k, metric, key, vec)


def signs(words: np.ndarray, dims: int) -> np.ndarray:
    """Bits of words [n, ceil(D / 64)] as 1 and -1."""
    return np.unpackbits(np.ascontiguousarray(words).astype("<i8").view(np.uint8).reshape(len(words), -1), axis=1, count=dims, bitorder="little").astype(np.float64) * 2 - 1


def _prepared(q: np.ndarray, center: np.ndarray, metric: str) -> np.ndarray:
    q = q.astype(np.float64)
    if metric == "cosine":
        length = np.sqrt((q * q).sum(1, keepdims=True))
        q = np.divide(q, length, out=q.copy(), where=length > 0)
    return q if metric == "ip" else q - center


def least_distances(sign: np.ndarray, norm: np.ndarray, vdot: np.ndarray, q: np.ndarray, center: np.ndarray, metric: str) -> np.ndarray:
    """``least_distance`` for all pairs [queries, rows]."""
    given, q = q.astype(np.float64), _prepared(q, center, metric)
    size = (q * q).sum(1)[:, None]
    along = q @ sign.T / np.sqrt(sign.shape[1])
    across = np.sqrt(np.maximum(1 - vdot * vdot, 0) + 1e-6)[None, :] * np.sqrt(np.maximum(size - along * along, 0) + 1e-12 * size)
    most = norm[None, :] * (vdot[None, :] * along + across) + 1e-6 * norm[None, :] * np.sqrt(size)
    if metric == "ip":
        return -(most + (given @ center)[:, None]) - 1e-6 * (np.abs(given) @ np.abs(center))[:, None]
    squared = (norm * norm * (1 - 1e-6))[None, :] + size * (1 - 1e-6) - 2 * most
    return np.sqrt(np.maximum(squared, 0)) if metric == "l2sq" else squared / 2


def near_codes(coded: DataFrame, block, k: int, center: Sequence[float], metric: str, oversample: int = 3, key: str = "key", vec: str = "vec") -> DataFrame:
    """``qid, key, dist``: for each query of ``block`` the nearest ``k`` of each task's rows, by codes first.

    ``coded``: key, vec and maybe code, which is made here if it is not there.  In each batch the ``k * oversample`` rows nearest by their codes set
    the limit; of the others only those whose code allows a distance within it, and which a matrix
    product does not rule out, are computed exactly, in pieces: at 64 dimensions the codes alone leave
    nearly all pairs of a tile.
    """
    metric, middle = distances.metric_name(metric), np.array(center, np.float64)
    dims = len(middle)

    def f(batches):
        ids, q = block.value
        if len(q) and q.shape[1] != dims:
            raise ValueError(f"query vectors must have {dims} dimensions")
        own_words, own_norm, own_vdot = encode(q, middle, metric)
        best, screen = Nearest(len(ids), k), Screen(metric, q, middle)
        for batch in batches:
            for a in range(0, batch.num_rows, ROW_TILE):
                part = batch.slice(a, ROW_TILE)
                keys, x = part.column(0).to_numpy(), vectors_of(part.column(1), dims)
                code = part.column(2) if part.num_columns > 2 else None
                words, norm, vdot = encode(x, middle, metric) if code is None else (vectors_of(code.field("bits")), code.field("norm").to_numpy(), code.field("vdot").to_numpy())
                sign, held, norm, vdot = signs(words, dims), screen.rows(x), norm.astype(np.float64), vdot.astype(np.float64)
                for b in range(0, len(ids), ASKED_TILE):
                    at = slice(b, min(b + ASKED_TILE, len(ids)))
                    agree = signs(own_words[at], dims) @ sign.T / dims
                    guess = norm[None, :] ** 2 - 2 * own_norm[at][:, None] * norm[None, :] * own_vdot[at][:, None] * vdot[None, :] * agree
                    n = min(k * oversample, len(keys))
                    first = np.zeros(guess.shape, bool)
                    np.put_along_axis(first, np.argpartition(guess, n - 1, axis=1)[:, :n], True, axis=1)
                    screen.compare(best, at, keys, x, first)
                    rest = ~first & (least_distances(sign, norm, vdot, q[at], middle, metric) <= best.limit(at)[:, None])
                    rest &= screen.passing(at, best, keys, x, held)
                    screen.compare(best, at, keys, x, rest)
        for a in range(0, len(ids), DEALT):
            yield best.rows(ids, slice(a, a + DEALT))

    return coded.select(F.col(key).cast("long"), F.col(vec).cast("array<float>"), *[c for c in coded.columns if c == "code"]).mapInArrow(f, FOUND)


def search_join(queries: DataFrame, items: DataFrame, k: int, center: Sequence[float], metric: str = "l2sq", query_key: str = "qid", query_vec: str = "qvec", key: str = "vec_id", vec: str = "embedding", oversample: int = 3) -> DataFrame:
    """``qid, key, dist, rank``: ``search`` for every query row, by one scan of the codes."""
    if oversample <= 0:
        raise ValueError("hnsw_rabitq_oversample must be greater than 0")
    rows = items.where(F.col(vec).isNotNull())
    return ranked(in_blocks(asked_of(queries, query_key, query_vec), lambda shared: near_codes(rows, shared, k, center, metric, oversample, key, vec)), k)
