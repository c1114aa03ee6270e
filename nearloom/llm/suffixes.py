"""Removing long repeated byte strings: a family of sparse suffix arrays, merged geometrically.

A string of ``length`` bytes is judged by its start.  In each such window the ``anchor``-byte
string with the least hash is its anchor, so equal windows have equal anchors at equal places, and
the starts of a document fall into short ranges of one anchor each.  The suffixes at anchors are
all that an index holds: about one in a hundred bytes (a sparse suffix array).

Index levels are tables of suffixes in order of their first ``ORDERED`` bytes and, where these are
equal, of the fingerprint of the whole anchor; only equality of long prefixes matters beyond.  A
new batch of documents becomes a level; it is merge-scanned against the levels that exist, which
gives the anchors that recur; levels of equal size are merged.

Which starts recur is then exact:
* a range that recurs as a whole, with all bytes that its windows touch, recurs at every start;
* of an anchor with several different ranges, one range of each kind (a context of some 500
  bytes) is compared window by window, in groups of one anchor each.  Anchors with more than
  ``HOT`` kinds are not grouped: their windows' fingerprints are counted by an aggregate instead.

Documents are known by a 128-bit hash of their text, as equal texts lose equal bytes; the long
texts are cut into slices of ``SLICE`` starts.  Fingerprints have 128 bits in all, and no text is
shuffled while the ranges concerned, and then the runs to remove, are within ``BROADCAST_IDS``.

Besides, the same is done with words in the place of bytes (a code of four bytes each), which
finds the passages of more than ``PASSAGE`` words that recur.  They are counted, not removed.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows
are repeats of each other; an empty table gives an empty result; other columns ride along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearloom.llm.common import BROADCAST_IDS, FLUSH_BYTES, Scratch, binary_list, checkpointed, joined_row, releasing, shuffle_partitions, split_row
from nearloom.llm.shingles import mix, powers, prefix_hashes

LENGTH = 400
ANCHOR = 128
SLICE = 1 << 20
HOT = 4096
ORDERED = 8
#: A passage has more words than this; the bytes of a word's code; the words of an anchor.
PASSAGE, CODE, ANCHOR_WORDS = 50, 4, 16
SALTS = 64

_RANGES = "p long, h long, f long, k1 long, k2 long, lo int, hi int"
_PARTS = pa.schema([("p", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def anchored_ranges(parts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, range fingerprint, part, first and last start of every range of the parts, and the anchor's place."""
    lengths = np.array([len(p) for p in parts])
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    width = length - anchor + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(buffer) < length:
        return none
    up, down = powers(len(buffer) + 1)
    sums = prefix_hashes(buffer, up)
    hashes = mix((sums[anchor:] - sums[:-anchor]) * down[: len(sums) - anchor])
    low = np.uint64((1 << max(24, int(len(buffer)).bit_length())) - 1)
    least = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    owner = (least & low).astype(np.int64)
    ends = np.cumsum(lengths)
    begins, whole = ends - lengths, lengths >= length
    inside = np.zeros(len(owner) + 1, np.int8)
    inside[begins[whole]] += 1
    inside[ends[whole] - length + 1] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    part = np.searchsorted(ends, np.arange(len(owner)), "right") if len(parts) > 1 else np.zeros(len(owner), np.int64)
    change = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]) | (part[1:] != part[:-1])]))
    last = np.concatenate([change[1:], [len(owner)]]) - 1
    change, last = change[inside[change]], last[inside[change]]
    at = owner[change]
    shape = (at - change).astype(np.uint64) << np.uint64(32) | (last - change).astype(np.uint64)
    whole_range = mix(mix((sums[last + length] - sums[change]) * down[change]) + shape * np.uint64(0x9E3779B97F4A7C15))
    of = part[change]
    return hashes[at], whole_range, of, change - begins[of], last - begins[of], at


def word_codes(text: bytes) -> bytes:
    """Four bytes for each word (between white space, A-Z lower-cased), so that equal runs of words are equal strings."""
    buffer = np.frombuffer(text.lower() + b"\n", np.uint8)
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(buffer) + 1)
    sums = prefix_hashes(buffer, up)
    return (mix((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(32)).astype("<u4").tobytes()


def _sampled(length: int, anchor: int, view):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            parts, of, offset, size = [], [], [], 0

            def done() -> pa.RecordBatch:
                h, g, part, lo, hi, at = anchored_ranges(parts, length, anchor)
                joined = np.frombuffer(b"".join(parts), np.uint8)
                p = np.zeros(len(at), np.uint64)  # the first bytes as a number, so that numbers are ordered as the bytes are
                for i in range(ORDERED):
                    p = p << np.uint64(8) | joined[at + i].astype(np.uint64)
                row, off = np.array(of, np.int64)[part], np.array(offset, np.int64)[part]
                return pa.RecordBatch.from_arrays([pa.array((p ^ np.uint64(1 << 63)).view(np.int64)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]), pa.array((lo + off).astype(np.int32)), pa.array((hi + off).astype(np.int32))], schema=_PARTS)

            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                text = view(text.as_py() or b"")
                for at in range(0, max(0, len(text) - length + 1), SLICE):
                    parts.append(text[at : at + SLICE + length - 1])
                    of.append(i)
                    offset.append(at)
                    size += len(parts[-1])
                    if size > SLICE:
                        yield done()
                        parts, of, offset, size = [], [], [], 0
            if parts:
                yield done()

    return f


def _contexts(length: int, view):
    """The bytes that the windows of each wanted range touch."""
    schema = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("bytes", pa.binary())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                text, wanted = view(text.as_py()), batch.column(3)[i].as_py()
                for a in range(0, len(wanted), 10_000):
                    some = wanted[a : a + 10_000]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([x["h"] for x in some], pa.int64()), pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), pa.array([x["lo"] for x in some], pa.int32()), pa.array([text[x["lo"] : x["hi"] + length] for x in some], pa.binary())], schema=schema)

    return f


def window_hashes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of the contexts, its context and its start there."""
    sizes = np.array([len(c) - length + 1 for c in contexts])
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    up, down = powers(len(buffer) + 1)
    sums = prefix_hashes(buffer, up)
    of = np.repeat(np.arange(len(contexts)), sizes)
    start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = start + (np.cumsum([0] + [len(c) for c in contexts])[:-1])[of]
    return mix((sums[at + length] - sums[at]) * down[at]), of, start


_INTERVALS = "k1 long, k2 long, a int, b int"


def _intervals(k1: list[int], k2: list[int], lo: np.ndarray, of: np.ndarray, start: np.ndarray, repeated: np.ndarray, length: int) -> pa.RecordBatch:
    """Bytes covered by repeated windows; windows lie in order of context and start."""
    index = np.flatnonzero(repeated)
    first = np.concatenate([[True], (np.diff(index) != 1) | (of[index[1:]] != of[index[:-1]])]) if len(index) else np.zeros(0, bool)
    a, b = index[first], index[np.concatenate([first[1:], [True]])] if len(index) else index
    c = of[a]
    return pa.RecordBatch.from_arrays([pa.array(np.array(k1, np.int64)[c]), pa.array(np.array(k2, np.int64)[c]), pa.array((lo[c] + start[a]).astype(np.int32)), pa.array((lo[c] + start[b] + length).astype(np.int32))], names=["k1", "k2", "a", "b"])


def _grouped(length: int, rows: int = 8192):
    """Windows that recur within an anchor's contexts; rows come sorted by anchor."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        h = t.column("h").to_numpy()
        hashes, of, start = window_hashes(t.column("bytes").to_pylist(), length)
        key = mix(hashes ^ mix(h.view(np.uint64))[of])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return _intervals(t.column("k1").to_pylist(), t.column("k2").to_pylist(), t.column("lo").to_numpy().astype(np.int64), of, start, count[inverse] > 1, length)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield judged(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield judged(pa.Table.from_batches(held))

    return f


def _exploded(length: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                hashes, of, _ = window_hashes(part.column("bytes").to_pylist(), length)
                key = mix(hashes ^ mix(part.column("h").to_numpy().view(np.uint64))[of])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return f


def _marked(length: int, repeated):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                hashes, of, start = window_hashes(part.column("bytes").to_pylist(), length)
                key = mix(hashes ^ mix(part.column("h").to_numpy().view(np.uint64))[of]).view(np.int64)
                at = np.minimum(np.searchsorted(repeated.value, key), len(repeated.value) - 1)
                yield _intervals(part.column("k1").to_pylist(), part.column("k2").to_pylist(), part.column("lo").to_numpy().astype(np.int64), of, start, repeated.value[at] == key, length)

    return f


class IndexFamily:
    """Levels of sampled suffixes; ``add`` a batch, then ask for the ``intervals`` that recur."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR, view: Callable[[bytes], bytes] = bytes, scratch: Scratch | None = None) -> None:
        """``view`` turns a text into the string that is indexed; tables live in ``scratch``."""
        self.length, self.anchor, self.view, self.scratch = length, anchor, view, scratch
        self.levels: list[tuple[int, DataFrame]] = []  # (batches within, table), the largest first
        self.found: DataFrame | None = None  # anchors that recur

    def _sorted(self, rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(shuffle_partitions(rows.sparkSession), F.col("h"), F.pmod("k1", F.lit(SALTS)))  # an anchor may hold a third of all rows
        return self.scratch.put(dealt.sortWithinPartitions("p", "h"))

    def add(self, texts: DataFrame) -> None:
        """``texts``: k1, k2 (a hash of the text) and text."""
        self.scratch = self.scratch or Scratch(texts.sparkSession)
        new = self._sorted(texts.mapInArrow(releasing(_sampled(self.length, self.anchor, self.view)), _RANGES))
        scans = [new.groupBy("h").count().where("count > 1").select("h")]
        scans += [new.select("h").distinct().join(level.select("h"), "h", "left_semi") for _, level in self.levels]
        for scan in scans:
            found = self.scratch.put(scan)
            self.found = found if self.found is None else self.found.unionByName(found)
        size = 1
        while self.levels and self.levels[-1][0] == size:
            old = self.levels.pop()[1]
            merged = self._sorted(old.unionByName(new))
            self.scratch.drop(old, new)
            new, size = merged, 2 * size
        self.levels.append((size, new))
        self.scratch.tidy()

    def intervals(self, texts: DataFrame) -> DataFrame:
        """``k1, k2, spans``: the maximal runs of bytes to remove, in order, of each text that has any."""
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        put = self.scratch.put
        found = put(self.found.distinct())
        few = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
        # an anchor or a range may hold a third of all rows: they are counted in salted parts before they meet
        salt = F.pmod(F.xxhash64("k1", "lo"), F.lit(SALTS)).alias("salt")
        again = rows.join(few, "h", "left_semi").select("h", "f", "k1", "k2", "lo", "hi", salt)
        parts = again.repartition(shuffle_partitions(texts.sparkSession), "h", "f", "salt").groupBy("h", "f", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one"))
        kinds = put(parts.groupBy("h", "f").agg(F.sum("n").alias("n"), F.min("one").alias("one")))
        whole = again.join(kinds.where("n > 1").select("h", "f"), ["h", "f"]).select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + self.length).alias("b")).distinct()
        several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        wanted = kinds.join(several, "h").select("h", "kinds", "one.*")
        by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("wanted"))
        by_text = put(by_text)
        self.scratch.tidy()
        few = _broadcast_if_small(by_text, "wanted")
        held = texts.join(few, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
        contexts = held.mapInArrow(releasing(_contexts(self.length, self.view)), "h long, k1 long, k2 long, lo int, bytes binary").dropDuplicates(["h", "k1", "k2", "lo"])
        contexts = put(contexts.join(several, "h"))
        parts = [whole]
        grouped = contexts.where(F.col("kinds") <= HOT).drop("kinds").repartition(shuffle_partitions(texts.sparkSession), "h").sortWithinPartitions("h")
        parts.append(grouped.mapInArrow(releasing(_grouped(self.length)), _INTERVALS))
        hot = contexts.where(F.col("kinds") > HOT).drop("kinds")
        if not hot.isEmpty():
            counted = put(hot.mapInArrow(releasing(_exploded(self.length)), "key long").groupBy("key").count().where("count > 1").select("key"))
            n, block = counted.count(), 4_000_000  # keys of one broadcast: 32 MB
            for i in range(-(-n // block)):
                keys = counted if n <= block else counted.where(F.pmod(F.xxhash64("key"), F.lit(-(-n // block))) == i)
                repeated = np.sort(np.array([r.key for r in keys.toLocalIterator()], np.int64))
                parts.append(hot.mapInArrow(_marked(self.length, texts.sparkSession.sparkContext.broadcast(repeated)), _INTERVALS))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        spans = every.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("all"))
        return spans.select("k1", "k2", "all").mapInArrow(_merged, "k1 long, k2 long, all array<struct<a:int, b:int>>")


def _runs(spans: list[dict]) -> list[list[int]]:
    """Maximal runs of intervals that come in order."""
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["a"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["b"])
        else:
            merged.append([s["a"], s["b"]])
    return merged


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        runs = [[{"a": a, "b": b} for a, b in _runs(x.as_py())] for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, span)], names=["k1", "k2", "all"])


def _broadcast_if_small(df: DataFrame, lists: str) -> DataFrame:
    """For a broadcast, if rows and list elements together are within ``BROADCAST_IDS``."""
    held = df.agg(F.coalesce(F.sum(F.size(lists) + F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_IDS else df


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``__text, __rest, all, passages`` to what is kept, the runs removed, and the passages' number."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for whole in batches:
        step = max(1, whole.num_rows * FLUSH_BYTES // max(1, whole.nbytes))
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            kept, runs, sizes, passages = [], [], [], [len(_runs(x.as_py() or [])) for x in batch.column(3)]
            for text, spans in zip(binary_list(batch.column(0)), batch.column(2), strict=True):
                merged = _runs(spans.as_py() or [])
                out, upto = [], 0
                for a, b in merged:
                    out.append(text[upto:a])
                    upto = b
                kept.append(b"".join([*out, text[upto:]]))
                runs.append([{"a": a, "b": b} for a, b in merged])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), batch.column(1), pa.array(runs, span), pa.array(sizes, pa.int64()), pa.array(passages, pa.int64())], names=["kept", "__rest", "spans", "size", "passages"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = 2) -> DataFrame:
    """``docs`` with ``kept`` (the bytes left), ``spans`` (what was removed), ``n_bytes`` and ``n_passages``.

    ``text_col`` stays as it was.  The documents enter the index in ``batches``, by their text's hash.
    ``n_passages``: runs of words, each within a string of more than ``PASSAGE`` words that also
    starts anywhere else.
    """
    rows, _ = split_row(docs, id_col, text_col)
    rest = rows.schema["__rest"].dataType
    keyed = rows.select(F.xxhash64("__text").alias("k1"), F.xxhash64(F.lit(1), "__text").alias("k2"), "__text", "__rest")
    texts = keyed.select("k1", "k2", F.col("__text").alias("text"))

    def found(name: str, *options) -> DataFrame:
        with Scratch(docs.sparkSession) as scratch:
            family = IndexFamily(*options, scratch=scratch)
            for b in range(batches):
                family.add(texts.where(F.pmod("k2", F.lit(batches)) == b))
            return _broadcast_if_small(checkpointed(family.intervals(texts)).withColumnRenamed("all", name), name)

    whole = keyed.join(found("all", length), ["k1", "k2"], "left")
    whole = whole.join(found("passages", CODE * (PASSAGE + 1), CODE * ANCHOR_WORDS, word_codes), ["k1", "k2"], "left").select("__text", "__rest", "all", "passages")
    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("__rest", rest), T.StructField("spans", span), T.StructField("size", T.LongType()), T.StructField("passages", T.LongType())])
    done = whole.mapInArrow(releasing(_cut), schema)
    return joined_row(done, [c for c in docs.columns if c != text_col], text_col, {"kept": "kept", "spans": "spans", "n_bytes": "size", "n_passages": "passages"})
