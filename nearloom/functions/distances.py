"""Distances and similarities between embedding columns, in double precision.

With a known dimension they are written out term by term, which stays in generated code; beyond
``UNROLL`` dimensions, or without one, higher-order functions are used.  A null vector gives null,
vectors of different lengths an error.  A zero vector has no direction: cosine gives NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 128

#: Metric names and what they may be called.
ALIASES = {"l2sq": "l2sq", "l2": "l2sq", "cosine": "cosine", "cos": "cosine", "ip": "ip"}
METRICS = ("cosine", "ip", "l2sq")


def metric_name(name: str) -> str:
    if not isinstance(name, str) or name.lower() not in ALIASES:
        raise ValueError(f"Unknown metric: {name!r}")
    return ALIASES[name.lower()]


def vector(values: Sequence[float]) -> Column:
    """A constant query vector, rounded to single precision as stored vectors are."""
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def _folded(a: Column, b: Column, term: Callable[[Column, Column], Column], dims: int | None) -> Column:
    if dims is not None and dims <= UNROLL:
        terms = [term(F.get(a, F.lit(i)).cast("double"), F.get(b, F.lit(i)).cast("double")) for i in range(dims)]
        total = terms[0] if terms else F.lit(0.0)
        for t in terms[1:]:
            total = total + t
    else:
        total = F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, t: s + t)
    differ = (F.size(a) != F.size(b)) if dims is None else (F.size(a) != dims) | (F.size(b) != dims)
    says = F.raise_error(F.lit("vectors must be of one length" if dims is None else f"vectors must have {dims} dimensions")).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(differ, says).otherwise(total)


def inner_product(a: Column, b: Column, dims: int | None = None) -> Column:
    return _folded(a, b, lambda x, y: x * y, dims)


def l2_squared(a: Column, b: Column, dims: int | None = None) -> Column:
    return _folded(a, b, lambda x, y: (x - y) * (x - y), dims)


def l2_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    return F.sqrt(l2_squared(a, b, dims))


def negative_inner_product(a: Column, b: Column, dims: int | None = None) -> Column:
    return -inner_product(a, b, dims)


def cosine_similarity(a: Column, b: Column, dims: int | None = None) -> Column:
    norms = F.sqrt(inner_product(a, a, dims)) * F.sqrt(inner_product(b, b, dims))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(inner_product(a, b, dims) / norms)


def cosine_distance(a: Column, b: Column, dims: int | None = None) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b, dims)


_DISTANCE = {"l2sq": l2_distance, "cosine": cosine_distance, "ip": negative_inner_product}
_SCORE = {"l2sq": l2_distance, "cosine": cosine_similarity, "ip": inner_product}


def distance(metric: str, a: Column, b: Column, dims: int | None = None) -> Column:
    """Smaller is nearer, for every metric."""
    return _DISTANCE[metric_name(metric)](a, b, dims)


def score(metric: str, a: Column, b: Column, dims: int | None = None) -> Column:
    """What join results report: a distance for l2sq, a similarity for cosine and ip."""
    return _SCORE[metric_name(metric)](a, b, dims)
