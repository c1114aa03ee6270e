"""A bidirectional gated recurrent classifier of word windows, trained in numpy.

A word enters by two ways: a bidirectional gated recurrent unit over its bytes, whose last states
are kept, and an embedding of its hash.  A second one runs over the words of a window; attention
pools its states into one logit.  At scoring, what the word level takes from a word depends on
the word alone, so it is computed once for each distinct word.
"""

from __future__ import annotations

import numpy as np

from nearloom.llm.common import release
from nearloom.llm.shingles import mix, powers, prefix_hashes

CHARS = 20  # bytes of a word unit; longer words are several units
WORDS = 48  # words of a window
STRIDE = 32
BUCKETS = 8192
H = 8  # states of each direction
PART = 1 << 17  # bytes hashed at once; half as many units are scored at once in training

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All word units of the texts: the lower-cased buffer, starts, lengths, and how many each text has."""
    buffer = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_WORD_BYTE[buffer], prepend=False))
    starts, lengths = edge[::2].copy(), edge[1::2] - edge[::2]
    del edge
    if len(lengths) and lengths.max() > CHARS:
        parts = -(-lengths // CHARS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, lengths = np.repeat(starts, parts) + nth * CHARS, np.minimum(np.repeat(lengths, parts) - nth * CHARS, CHARS)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buffer, starts, lengths, np.diff(np.searchsorted(starts, bounds))


def unit_hashes(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of units that lie in order, a part of the buffer at a time."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PART)))
        low, s, n = starts[a], starts[a:b] - starts[a], lengths[a:b]
        part = buffer[low : low + s[-1] + n[-1]]
        up, down = powers(len(part) + 1)
        sums = prefix_hashes(part, up)
        out[a:b] = mix((sums[s + n] - sums[s]) * down[s])
        a = b
    return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts laid end to end: index of the first unit, length, and text."""
    n = np.maximum(1, -(-(counts - WORDS) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(counts) - counts)[text]
    return base + nth * STRIDE, np.clip(counts[text] - nth * STRIDE, 0, WORDS), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _tanh(x: np.ndarray) -> np.ndarray:  # numpy's exp is about twice as fast as its tanh
    return 2 / (1 + np.exp(-2 * np.clip(x, -20, 20))) - 1


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    r = lambda *s, by=0.3: (g.standard_normal(s) * by).astype(np.float32)
    w = {"byte": r(256, 8), "word": r(BUCKETS, 8, by=0.05), "att": r(2 * H), "out": r(2 * H), "bias": np.full(1, -1.0, np.float32)}
    for name, size in (("cf", 8), ("cb", 8), ("wf", 2 * H + 8), ("wb", 2 * H + 8)):
        w |= {f"{name}x": r(size, 3 * H), f"{name}h": r(H, 3 * H), f"{name}b": np.zeros(3 * H, np.float32)}
    return w


def _run(xp: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States [T, B, H] of a gated recurrent unit over its projected inputs [T, B, 3H]."""
    t_most, b = mask.shape
    h, states, kept = np.zeros((b, H), np.float32), np.empty((t_most, b, H), np.float32), []
    for t in range(t_most):
        x, hh = xp[t], h @ wh
        zr = _sigmoid(x[:, : 2 * H] + hh[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = _tanh(x[:, 2 * H :] + r * hh[:, 2 * H :])
        m = mask[t][:, None]
        new = h + (n - h) * (1 - z) * m
        if keep:
            kept.append((h, z, r, n, hh[:, 2 * H :], m))
        h = states[t] = new
    return states, kept


def _back(d_states: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``wh``."""
    t_most, b, _ = d_states.shape
    d_xp, d_wh, dh = np.empty((t_most, b, 3 * H), np.float32), np.zeros_like(wh), np.zeros((b, H), np.float32)
    for t in range(t_most - 1, -1, -1):
        h, z, r, n, hn, m = kept[t]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * m * (1 - n * n)
        dz = dh * (h - n) * m * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        d_xp[t] = np.concatenate([dz, dr, dn], 1)
        d_hh = np.concatenate([dz, dr, dn * r], 1)
        d_wh += h.T @ d_hh
        dh = dh * (1 - (1 - z) * m) + d_hh @ wh.T
    return d_xp, d_wh


def _over_bytes(x: np.ndarray, alive: list[int], wx: np.ndarray, wb: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Last states over bytes [T, B] given as vectors; units lie longest first, ``alive[t]`` have a byte t."""
    h, kept = np.zeros((x.shape[1], H), np.float32), []
    for t, n in enumerate(alive):
        p, now = x[t, :n] @ wx + wb, h[:n].copy()
        hh = now @ wh
        zr = _sigmoid(p[:, : 2 * H] + hh[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        new = _tanh(p[:, 2 * H :] + r * hh[:, 2 * H :])
        h[:n] = new + (now - new) * z
        if keep:
            kept.append((now, z, r, new, hh[:, 2 * H :]))
    return h, kept


def _back_over_bytes(d_last: np.ndarray, kept: list, x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the byte vectors, ``wx``, ``wb`` and ``wh``."""
    dh, d_x, d_wx, d_wb, d_wh = d_last.copy(), np.zeros_like(x), np.zeros_like(wx), np.zeros(3 * H, np.float32), np.zeros_like(wh)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, hn = kept[t]
        d = dh[: len(h)]
        dn = d * (1 - z) * (1 - n * n)
        dz, dr = d * (h - n) * z * (1 - z), dn * hn * r * (1 - r)
        d_p, d_hh = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
        d_wx += x[t, : len(h)].T @ d_p
        d_wb += d_p.sum(0)
        d_wh += h.T @ d_hh
        d_x[t, : len(h)] = d_p @ wx.T
        dh[: len(h)] = d * z + d_hh @ wh.T
    return d_x, d_wx, d_wb, d_wh


def word_vectors(w: dict, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bucket: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Inputs [B, 2H + 8] of the word level; each unit takes as many steps as it has bytes."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    t = np.arange(int(n.max(initial=0)))[:, None]
    alive = (n[None, :] > t).sum(1).tolist()
    ahead = buffer[np.minimum(s[None, :] + t, len(buffer) - 1)]
    behind = buffer[np.clip(s[None, :] + n[None, :] - 1 - t, 0, len(buffer) - 1)]
    xa, xb = w["byte"][ahead], w["byte"][behind]
    out = np.empty((len(n), 2 * H + 8), np.float32)
    out[order, :H], ka = _over_bytes(xa, alive, w["cfx"], w["cfb"], w["cfh"], keep)
    out[order, H : 2 * H], kb = _over_bytes(xb, alive, w["cbx"], w["cbb"], w["cbh"], keep)
    out[:, 2 * H :] = w["word"][bucket]
    return out, (order, (ahead, xa, ka), (behind, xb, kb))


class WordTable:
    """What the word level takes from each distinct word, kept between batches."""

    def __init__(self, w: dict, most: int = 150_000) -> None:
        self.w, self.most = w, most
        self.wx = np.concatenate([w["wfx"], w["wbx"]], 1)
        self.wb = np.concatenate([w["wfb"], w["wbb"]])
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1024, 6 * H), np.float32)
        self.used = 1  # row 0 stands for no word

    def lookup(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        hashes, first, inverse = np.unique(unit_hashes(buffer, starts, lengths), return_index=True, return_inverse=True)
        if self.used + len(hashes) > self.most:
            self.clear()
        get = self.known.get
        row = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(row < 0)
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            vector = word_vectors(self.w, buffer, starts[first[part]], lengths[first[part]], (hashes[part] % BUCKETS).astype(np.int64))[0]
            while self.used + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((min(len(self.rows), max(self.most, self.used + len(part)) - len(self.rows)), 6 * H), np.float32)])
            self.rows[self.used : self.used + len(part)] = vector @ self.wx + self.wb
            row[part] = np.arange(self.used, self.used + len(part))
            self.known.update(zip(hashes[part].tolist(), row[part].tolist(), strict=True))
            self.used += len(part)
        return row[inverse]


def _pool(w: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = states @ w["att"] + (mask - 1) * 1e4
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, states)
    return pooled @ w["out"] + w["bias"], a, pooled


def window_logits(table: WordTable, row: np.ndarray, first: np.ndarray, length: np.ndarray, block: int = 512) -> np.ndarray:
    w, out = table.w, np.empty(len(first), np.float32)
    row = np.concatenate([row, [0]])
    t = np.arange(WORDS)[:, None]
    for at in range(0, len(first), block):
        n = length[at : at + block]
        mask = t < n[None, :]
        index = np.where(mask, row[np.minimum(first[at : at + block][None, :] + t, len(row) - 1)], 0)
        m = mask.astype(np.float32)
        xp = table.rows[index]
        f, _ = _run(xp[..., : 3 * H], w["wfh"], m, False)
        b, _ = _run(xp[::-1, :, 3 * H :], w["wbh"], m[::-1], False)
        out[at : at + block] = _pool(w, np.concatenate([f, b[::-1]], 2), m)[0]
    return out


def step(w: dict, units_of: tuple, first: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients over a batch of windows."""
    buffer, starts, lengths, hashes = units_of
    t = np.arange(WORDS)[:, None]
    mask = t < length[None, :]
    at = np.where(mask, np.minimum(first[None, :] + t, max(0, len(hashes) - 1)), -1)
    used = np.where(at >= 0, hashes[at] if len(hashes) else 0, 0)
    distinct, where, inverse = np.unique(used, return_index=True, return_inverse=True)
    inverse = inverse.reshape(at.shape)
    place = at.ravel()[where]
    bucket = (distinct % BUCKETS).astype(np.int64)
    vector, (by_length, *runs) = word_vectors(w, buffer, starts[place] if len(starts) else place * 0, np.where(place >= 0, lengths[place] if len(lengths) else 0, 0), bucket, True)
    m = mask.astype(np.float32)
    v = vector[inverse]
    f, wkf = _run(v @ w["wfx"] + w["wfb"], w["wfh"], m, True)
    b, wkb = _run(v[::-1] @ w["wbx"] + w["wbb"], w["wbh"], m[::-1], True)
    states = np.concatenate([f, b[::-1]], 2)
    logit, a, pooled = _pool(w, states, m)
    p = _sigmoid(logit)
    loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).mean())
    d = ((p - y) * weight / len(y)).astype(np.float32)
    g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    d_pooled = d[:, None] * w["out"]
    d_a = np.einsum("tbh,bh->tb", states, d_pooled)
    d_logit = a * (d_a - (a * d_a).sum(0))
    g["att"] = np.einsum("tb,tbh->h", d_logit, states)
    d_states = a[..., None] * d_pooled[None] + d_logit[..., None] * w["att"]
    d_v = np.zeros_like(v)
    for name, kept, ds, vv, flip in (("wf", wkf, d_states[..., :H], v, False), ("wb", wkb, d_states[::-1, :, H:], v[::-1], True)):
        d_xp, g[f"{name}h"] = _back(ds, kept, w[f"{name}h"])
        flat = d_xp.reshape(-1, 3 * H)
        g[f"{name}x"], g[f"{name}b"] = vv.reshape(len(flat), -1).T @ flat, flat.sum(0)
        dv = d_xp @ w[f"{name}x"].T
        d_v += dv[::-1] if flip else dv
    d_vector = np.empty_like(vector)
    for j in range(vector.shape[1]):
        d_vector[:, j] = np.bincount(inverse.ravel(), d_v[..., j].ravel(), minlength=len(vector))
    g["word"] = np.zeros_like(w["word"])
    np.add.at(g["word"], bucket, d_vector[:, 2 * H :])
    g["byte"] = np.zeros_like(w["byte"])
    for name, part, (chars, x, kept) in (("cf", d_vector[:, :H], runs[0]), ("cb", d_vector[:, H : 2 * H], runs[1])):
        d_x, g[f"{name}x"], g[f"{name}b"], g[f"{name}h"] = _back_over_bytes(part[by_length], kept, x, w[f"{name}x"], w[f"{name}h"])
        for j in range(8):
            g["byte"][:, j] += np.bincount(chars.ravel(), d_x[..., j].ravel(), minlength=256)
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.025, seed: int = 7, refresh: int = 60) -> dict[str, np.ndarray]:
    """Weights learned from whole texts with a label each; a third of each batch is positive.

    A label holds for a text, not for each of its windows.  So every ``refresh`` steps all windows
    are scored, and those of a positive text are then drawn in proportion to exp(logit), which
    settles on the ones that explain the label.  Windows of negative texts are drawn evenly.
    """
    w, g = new_weights(seed), np.random.default_rng(seed)
    buffer, starts, lengths, counts = units(texts)
    units_of = buffer, starts, lengths, unit_hashes(buffer, starts, lengths)
    first, length, text = windows(counts)
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    own = np.diff(at)
    chance = np.repeat(1 / own, own)
    upto_units = np.cumsum([0, *counts])
    cuts = np.unique(np.searchsorted(upto_units, [*range(0, upto_units[-1], PART // 2), upto_units[-1]])).tolist()
    cuts = [*dict.fromkeys([0, *cuts, len(texts)])]
    y = np.asarray(labels, np.float32)[text]
    positive, negative, n = np.flatnonzero(np.asarray(labels) == 1), np.flatnonzero(y == 0), batch // 3
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    for done in range(1, steps + 1):
        if done % refresh == 0:
            table = WordTable(w)
            logit = np.empty(len(first))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                u, v, own_windows = upto_units[a], upto_units[b], slice(at[a], at[b])
                row = table.lookup(buffer, starts[u:v], lengths[u:v])
                logit[own_windows] = window_logits(table, row, first[own_windows] - u, length[own_windows])
                release()
            del table
            release()
            likely = np.exp(np.clip(logit - np.repeat(np.maximum.reduceat(logit, at[:-1]), own), -30, 0) * min(2.0, 4 * done / steps))
            chance = likely / np.repeat(np.add.reduceat(likely, at[:-1]), own)
        upto, t = np.cumsum(chance), g.choice(positive, n)
        before = upto[at[t]] - chance[at[t]]
        found = np.clip(np.searchsorted(upto, before + g.random(n) * (upto[at[t + 1] - 1] - before)), at[t], at[t + 1] - 1)
        pick = np.concatenate([found, g.choice(negative, batch - n)])
        _, grad = step(w, units_of, first[pick], length[pick], y[pick], np.ones(batch, np.float32))
        now = rate * min(1, done / 20) * (1 - 0.95 * done / steps)
        norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        for k, v in grad.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9)) + (1e-4 * w[k] if k == "word" else 0)
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.005 * (v * v - square[k])
            w[k] -= (now * (mean[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.995**done)) + 1e-8)).astype(np.float32)
    return w
