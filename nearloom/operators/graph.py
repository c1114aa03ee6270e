"""A hierarchical proximity graph in numpy, searched with or without a predicate.

Every node gets a random level and is linked on each of its levels to diverse near neighbours, as
published; these are not sought by walks but by matrix products, for many nodes at once.  A search descends greedily and ends with a bounded beam on the lowest level.
With a predicate the beam steps over nodes that fail: it goes on to their neighbours (and a third
hop while few results are known), so that sparse predicates do not cut the graph apart.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


#: Nodes linked at once, and pairs of candidates compared at once.
TILE, PAIRS = 256, 1 << 22


class Graph:
    def __init__(self, dims: int, metric: str = "l2sq", m: int = 16, m0: int = 32, ef_construction: int = 128, seed: int = 0) -> None:
        self.metric, self.m, self.m0, self.ef_construction = metric, m, m0, ef_construction
        self.x = np.zeros((0, dims), np.float32)
        self.links: list[list[list[int]]] = []  # node, level: neighbours
        self.entry = -1
        self._random = np.random.default_rng(seed)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(x, np.float32)
        if self.metric == "cosine":
            norm = np.linalg.norm(x, axis=-1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return x

    def distances(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        """To prepared vectors; ordered as the metric is (cosine of a zero vector: 1)."""
        v = self.x[nodes]
        if self.metric == "l2sq":
            d = v - q
            return np.einsum("ij,ij->i", d, d)
        return 1.0 - v @ q

    @property
    def top_level(self) -> int:
        return len(self.links[self.entry]) - 1 if self.entry >= 0 else -1

    def _greedy(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.distances(q, [at])[0])
        while True:
            near = self.links[at][level]
            if not near:
                return at
            d = self.distances(q, near)
            i = int(np.argmin(d))
            if d[i] >= best:
                return at
            best, at = float(d[i]), near[i]

    def _beam(self, q: np.ndarray, start: int, ef: int, level: int, allowed: np.ndarray | None = None, hops: bool = False) -> list[tuple[float, int]]:
        """The nearest ``ef`` found (of the allowed), as (distance, node), nearest first."""
        seen = {start}
        d = float(self.distances(q, [start])[0])
        ahead, top = [(d, start)], []
        if allowed is None or allowed[start]:
            top.append((-d, -start))
        while ahead:
            d, at = heapq.heappop(ahead)
            if len(top) >= ef and d > -top[0][0]:
                break
            fresh = [n for n in self.links[at][level] if n not in seen]
            seen.update(fresh)
            if hops and allowed is not None and fresh:
                passing = [n for n in fresh if allowed[n]]
                if len(passing) < 0.9 * len(fresh):
                    frontier = [n for n in fresh if not allowed[n]]
                    for _ in range(2 if len(top) < ef / 2 else 1):
                        further = [n for f in frontier for n in self.links[f][level]]
                        further = [n for n in dict.fromkeys(further) if n not in seen]
                        seen.update(further)
                        fresh += further
                        frontier = [n for n in further if not allowed[n]]
            if not fresh:
                continue
            for v, n in zip(self.distances(q, fresh).tolist(), fresh, strict=True):
                full = len(top) >= ef
                if full and v >= -top[0][0]:
                    continue
                heapq.heappush(ahead, (v, n))
                if allowed is None or allowed[n]:
                    heapq.heappush(top, (-v, -n))
                    if len(top) > ef:
                        heapq.heappop(top)
        return sorted((-v, -n) for v, n in top)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all pairs [..., a, b], by a product."""
        dot = a @ np.swapaxes(b, -1, -2)
        if self.metric != "l2sq":
            return 1.0 - dot
        return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * dot, 0)

    def _diverse(self, v: np.ndarray, near: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
        """Which of the candidates ``near`` [nodes, n], nearest first (infinite: none), are nearer to the node than to any kept before them."""
        kept = np.zeros(d.shape, bool)
        between, least, count = self._between(v[near], v[near]), np.full(d.shape, np.inf, np.float32), np.zeros(len(d), int)
        for c in range(d.shape[1]):
            kept[:, c] = ok = (least[:, c] > d[:, c]) & (count < most) & np.isfinite(d[:, c])
            count += ok
            some = np.flatnonzero(ok)
            least[some, c + 1 :] = np.minimum(least[some, c + 1 :], between[some, c, c + 1 :])
        return kept

    def _linked(self, v: np.ndarray, first: int, last: int, links: list[list[int]], most: int) -> None:
        """Link the nodes ``first`` to ``last`` of ``v`` with near ones before ``last``, and these with them."""
        c = min(self.ef_construction, last - 1)
        back: dict[int, list[int]] = {}
        for a in range(first, last, TILE):
            at = np.arange(a, min(a + TILE, last))
            d = self._between(v[at], v[:last])
            d[np.arange(len(at)), at] = np.inf
            near = np.argpartition(d, c - 1, axis=1)[:, :c]
            near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)
            for node, found, kept in zip(at.tolist(), near, self._diverse(v, near, np.take_along_axis(d, near, 1), self.m), strict=True):
                links[node] = found[kept].tolist()
                for n in links[node]:
                    back.setdefault(n, []).append(node)
        full: list[tuple[int, list[int]]] = []
        for n, more in back.items():
            links[n] = list(dict.fromkeys(links[n] + more))
            if len(links[n]) > most:
                full.append((n, links[n]))
        full.sort(key=lambda x: -len(x[1]))
        while full:
            width = len(full[0][1])
            some, full = full[: max(1, PAIRS // width**2)], full[max(1, PAIRS // width**2) :]
            near = np.zeros((len(some), width), int)
            there = np.arange(width)[None, :] < np.array([len(x) for _, x in some])[:, None]
            near[there] = np.concatenate([x for _, x in some])
            d = np.where(there, self._between(v[[n for n, _ in some]][:, None, :], v[near])[:, 0, :], np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            for (n, _), found, kept in zip(some, near, self._diverse(v, near, d, most), strict=True):
                links[n] = found[kept].tolist()

    def build(self, x: np.ndarray) -> Graph:
        """Nodes come in rounds, each as many as there are; near ones are found by a matrix product."""
        self.x = self.prepared(x)
        levels = np.floor(-np.log(1 - self._random.random(len(self.x))) / math.log(self.m)).astype(int)
        self.links = [[[] for _ in range(level + 1)] for level in levels.tolist()]
        if not len(self.x):
            return self
        self.entry = int(np.argmax(levels))
        around = self.x.astype(np.float64).mean(0) if self.metric == "l2sq" else 0.0
        for level in range(self.top_level + 1):
            nodes = np.flatnonzero(levels >= level)
            v, links = (self.x[nodes] - around).astype(np.float32), [[] for _ in nodes]
            last = min(len(nodes), 2 * self.ef_construction)
            first = 0
            while first < len(nodes) > 1:
                self._linked(v, first, last, links, self.m0 if level == 0 else self.m)
                first, last = last, min(len(nodes), 2 * last)
            for node, near in zip(nodes.tolist(), links, strict=True):
                self.links[node][level] = nodes[near].tolist()
        return self

    def exact(self, q: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        nodes = np.arange(len(self.x)) if allowed is None else np.flatnonzero(allowed)
        if not len(nodes):
            return []
        d = self.distances(self.prepared(q), nodes)
        order = np.lexsort((nodes, d))[:k]
        return list(zip(d[order].tolist(), nodes[order].tolist(), strict=True))

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None, hops: bool = True) -> list[tuple[float, int]]:
        """The ``k`` nearest (allowed) nodes; exact where the beam finds fewer than there are."""
        if self.entry < 0 or k <= 0:
            return []
        q, at = self.prepared(q), self.entry
        for l in range(self.top_level, 0, -1):
            at = self._greedy(q, at, l)
        found = self._beam(q, at, max(ef, k), 0, allowed, hops)[:k]
        there = len(self.x) if allowed is None else int(allowed.sum())
        return found if len(found) >= min(k, there) else self.exact(q, k, allowed)
