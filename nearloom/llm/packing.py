"""Packing documents into sequences of a fixed number of tokens, best fit decreasing.

A document longer than a window is first cut into full windows; each is a sequence by itself.
What is left of each document goes, longest first, into the open window with the least
sufficient room, which a segment tree indexed by remaining capacity finds in O(log window).

There is one plan for all documents.  Pieces of one length are alike, so best fit decreasing needs
only how many there are of each: at most ``window`` numbers, whatever the corpus.  The plan says,
for each length, which ranks go to which sequences and where there; its size is bounded by the
number of lengths too.  A piece's rank among those of its length is its count within the task that
made it plus the counts of the tasks before.

Pieces are a table in the shared folder; only sizes and checksums move, never tokens.

Defined results: a null text is empty and has only the closing id; rows that repeat, also with
the same ``doc_id``, are packed each by itself; a null ``doc_id`` is kept as null; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.common import BROADCAST_IDS, checkpointed, releasing
from nearloom.llm.tokens import Encoder

WINDOW = 1024

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class CapacityTree:
    """A segment tree over capacities 0..size: how many windows are open at each."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << (size + 1 - 1).bit_length() if size else 1
        if self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i, count = capacity + self.leaves, self.count
        while i:
            count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open window that is at least ``need``; -1 if there is none."""
        count, i = self.count, need + self.leaves
        if count[i]:
            return need
        while i > 1:  # up to the first subtree on the right that holds a window, then down its left edge
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: Iterable[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each length; lengths must come in decreasing order."""
    tree, open_at, out, made = CapacityTree(window), [[] for _ in range(window + 1)], [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            room, which = window, made
            made += 1
        else:
            which = open_at[room].pop()
            tree.add(room, -1)
        out.append((which, window - room))
        if left := room - n:
            open_at[left].append(which)
            tree.add(left, 1)
    return out


class Plan:
    """Best fit decreasing over how many pieces there are of each length.

    For each length, segments of ranks: a segment's windows are consecutive, each takes ``each`` of
    its pieces from ``offset`` on.  Windows that hold the same lengths in the same order are a run;
    a run is split only where a length runs out within it, so runs and segments stay few.
    """

    def __init__(self, counts: dict[int, int], window: int = WINDOW) -> None:
        self.made, self.segments = 0, {}
        tree, runs = CapacityTree(window), [[] for _ in range(window + 1)]  # by room: (first window, how many)
        for length in sorted(counts, reverse=True):
            left, rank, own = counts[length], 0, []
            while left:
                room = tree.tightest(length)
                if room < 0:  # all that are still needed, at once
                    room, first, n = window, self.made, -(-left // (window // length))
                    self.made += n
                else:
                    first, n = runs[room].pop()
                    tree.add(room, -1)
                each = room // length  # a window that has taken one is the tightest for the next
                full = min(n, left // each)
                parts = [(full, each)] if full else []
                if full < n and left > full * each:
                    parts.append((1, left - full * each))
                for m, q in parts:
                    own.append((rank, q, first, window - room))
                    rank, left, n = rank + m * q, left - m * q, n - m
                    if spare := room - q * length:
                        runs[spare].append((first, m))
                        tree.add(spare, 1)
                    first += m
                if n:
                    runs[room].append((first, n))
                    tree.add(room, 1)
            self.segments[length] = np.array(own, np.int64).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            start, each, first, base = self.segments[n]
            i = np.searchsorted(start, rank[at], "right") - 1
            nth = rank[at] - start[i]
            sequence[at], offset[at] = first[i] + nth // each[i], base[i] + nth % each[i] * n
        return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Each document's tokens, closed by id 0, cut into full windows and a remainder.

    ``part`` is the task that made a piece, ``nth`` counts its pieces of that length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, closing, part, seen = Encoder(tokenizer_path), b"\0\0\0\0", TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            ids, starts, lengths, sums, totals, nths = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = encoder.encode(text.as_py() or "") + closing
                total = len(buffer) // 4
                for start in range(0, total, window):
                    end = min(start + window, total)
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(end - start)
                    sums.append(zlib.crc32(buffer[4 * start : 4 * end]))
                    totals.append(total)
                    nths.append(seen[end - start])
                    seen[end - start] += 1
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums, totals)], pa.array([part] * len(ids), pa.int64()), pa.array(nths, pa.int64())], names=[*_NAMES, "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(cut), f"{_PIECES}, part long, nth long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: the piece, its sequence and its place there."""
    cut = checkpointed(pieces(docs, tokenizer_path, window))
    counts = checkpointed(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))  # at most ``window`` rows a task
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)  # at most ``window`` rows
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], names=[*_NAMES, "sequence_id", "offset"])

    base = F.broadcast(base) if counts.count() <= BROADCAST_IDS else base
    ranked = cut.join(base, ["part", "length"]).select(*_NAMES, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
