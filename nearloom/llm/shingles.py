"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_MOST = 1 << 21  # powers kept; each Python worker keeps as many as its texts have needed
_kept = (_powers(_BASE, 1), _powers(_UNBASE, 1))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    global _kept
    if n > _MOST:
        return _powers(_BASE, n), _powers(_UNBASE, n)
    if n > len(_kept[0]):
        m = 1 << (n - 1).bit_length()
        _kept = _powers(_BASE, m), _powers(_UNBASE, m)
    return _kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of byte value times base**i before each position; wraps modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct hashes of its runs of ``k`` words.

    A-Z are lower-cased and words end at space and U+0009 to U+000D.  With fewer than ``k``
    words, the whole sequence is the one shingle; without words there is none.
    """
    buffer = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    up, down = powers(len(buffer) + 1)
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = prefix_hashes(buffer, up)
    word = mix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bounds)
    n = len(word)
    held = np.zeros(n, np.uint64)
    for j in range(k):
        if n > j:
            held[: n - j] = mix(held[: n - j] * np.uint64(0xD6E8FEB86659FD93) + word[j:] + np.uint64(j + 1))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(held[a : b - k + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for w in word[a:b]:
                one = mix(np.array([one ^ w]) * np.uint64(0xD6E8FEB86659FD93))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
