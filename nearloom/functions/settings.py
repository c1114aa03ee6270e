"""Search settings, kept in the session's configuration, and options of an index."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import SparkSession

from nearloom.functions import distances

#: name: (type, default).  ``SET name = value`` or ``spark.conf.set(name, value)`` changes one.
SETTINGS: dict[str, tuple[type, Any]] = {
    "hnsw_enable_experimental_persistence": (bool, False),  # indexes always persist; accepted
    "hnsw_ef_search": (int, None),
    "hnsw_masked_threshold": (float, 0.6),  # above: traverse without regard to the predicate
    "hnsw_bruteforce_threshold": (float, 0.01),  # below: scan what matches
    "hnsw_rabitq_oversample": (int, 3),
}


def setting(spark: SparkSession, name: str) -> Any:
    kind, default = SETTINGS[name]
    raw = spark.conf.get(name, None)
    if raw is None:
        return default
    try:
        value = raw.strip().lower() in ("true", "1", "on") if kind is bool else kind(raw)
    except ValueError:
        raise ValueError(f"{name} must be of type {kind.__name__}") from None
    if name in ("hnsw_rabitq_oversample", "hnsw_ef_search") and value <= 0:
        raise ValueError(f"{name} must be greater than 0")
    return value


@dataclass(frozen=True)
class IndexOptions:
    metric: str = "l2sq"
    M: int = 16
    M0: int = 32
    ef_construction: int = 128
    ef_search: int = 64
    quantization: str = "none"

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


_LEAST = {"ef_construction": 1, "ef_search": 1, "M": 2, "M0": 2}


def index_options(**given: Any) -> IndexOptions:
    """Checked options; ``M0`` is twice ``M`` unless given."""
    known: dict[str, Any] = {}
    for name, value in given.items():
        if name == "metric":
            if not isinstance(value, str):
                raise ValueError("HNSW index 'metric' must be a string")
            if value.lower() not in distances.METRICS:
                raise ValueError(f"HNSW index 'metric' must be one of: {', '.join(distances.METRICS)}")
            known[name] = value.lower()
        elif name == "quantization":
            if not isinstance(value, str):
                raise ValueError("HNSW index 'quantization' must be a string")
            if value.lower() not in ("rabitq", "none"):
                raise ValueError("HNSW index 'quantization' must be 'rabitq' or 'none'")
            known[name] = value.lower()
        elif name in _LEAST:
            if isinstance(value, bool) or not isinstance(value, int):
                raise ValueError(f"HNSW index '{name}' must be an integer")
            if value < _LEAST[name]:
                raise ValueError(f"HNSW index '{name}' must be at least {_LEAST[name]}")
            known[name] = value
        else:
            raise ValueError(f"Unknown option for HNSW index: '{name}'")
    known.setdefault("M0", 2 * known.get("M", IndexOptions.M))
    return IndexOptions(**known)
