"""Media columns: GIF streams as timed frames with colour histograms, and texts stored as GIFs.

Defined results: a null stream has no frames, a broken one those before the break (``gif_frames``:
``error`` says why, in one row without a frame number); so has one whose canvas is too large; a null or empty text is stored as 64 zero bytes; rows that repeat
are treated each by itself; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm import gif
from nearloom.llm.common import FLUSH_BYTES, binary_list

_FRAMES = "id long, frame int, start_ms long, duration_ms long, width int, height int, rgba binary, histogram array<long>, error string"
_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gif_frames(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """One row per frame of each stream: when it shows, its pixels and its colour histogram."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FRAMES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], schema=schema)
                start = 0
                try:
                    for i, frame in enumerate(gif.frames(data.as_py() or b"")):
                        yield one(key, i, start, 10 * frame.delay, frame.canvas.shape[1], frame.canvas.shape[0], frame.canvas.tobytes(), gif.histogram(frame.canvas), None)
                        start += 10 * frame.delay
                except (ValueError, IndexError) as e:
                    yield one(key, None, None, None, None, None, None, None, str(e))

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{gif_col}`")).mapInArrow(f, _FRAMES)


def feature(samples: bytes) -> str:
    """Sixteen shares (in thousandths) of the sample values, their mean and their deviation."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = counts @ values / n
    shares = counts.reshape(16, 16).sum(1) * 1000 // n
    return ",".join(map(str, shares.tolist())) + f";{mean:.3f};{np.sqrt(counts @ (values - mean) ** 2 / n):.3f}"


def stored(text: bytes, width: int = 64) -> tuple:
    """What ``texts_as_gif`` says of one text, from the bytes that were stored and read back."""
    payload = text + bytes(-len(text) % width if text else width)
    media = gif.encode(payload, width)
    back = gif.stored_samples(media)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)


def texts_as_gif(docs: DataFrame) -> DataFrame:
    """Each text stored losslessly as a GIF of 8-bit samples and read back."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}  # of texts just seen, since copies often lie together
        for whole in batches:
            step = max(1, whole.num_rows * FLUSH_BYTES // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = []
                for text in binary_list(batch.column(1)):
                    key = hashlib.blake2b(text, digest_size=16).digest()
                    if key not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[key] = stored(text)
                    rows.append(known[key])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[c.split()[0] for c in _STORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(f, _STORED)
