"""Plain statements of what the operators compute, for small inputs."""

import hashlib
import re

import numpy as np

SPACE = " \t\n\r\x0b\x0c"
UP = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(UP)


def line_dedup(rows, min_chars=20, min_docs=3):
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: low(x.strip(SPACE))
    holders = {}
    for n, (_, lines) in enumerate(docs):
        for k in {key(x) for x in lines}:
            holders.setdefault(k, []).append(n)
    out = []
    for i, lines in docs:
        def gone(x):
            h = holders[key(x)]
            if len(key(x)) < min_chars or len(h) < min_docs:
                return False
            known = [docs[n][0] for n in h if docs[n][0] is not None]
            return i != (max(known) if known else None)
        kept = [x for x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def contamination(rows, items, window=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, held = cut(text), set(), set()
        for a in range(len(w)):
            for n in sizes:
                if a + n <= len(w) and (got := windows.get(tuple(w[a : a + n]))):
                    hit |= set(range(a, a + n))
                    held |= got
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(rows, length=400):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def shingles(text, k):
    w = low(text).encode().split()
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((top(a), top(b)))
                        above[q] = p
    return {i: top(i) for i in ids}


def passages(rows, words=51):
    """Maximal runs of words that lie within strings of so many words which also start elsewhere."""
    texts = [tuple(low(t).encode().split()) for _, t in rows]
    seen = {}
    for w in texts:
        for s in range(len(w) - words + 1):
            seen[w[s : s + words]] = seen.get(w[s : s + words], 0) + 1
    out = []
    for w in texts:
        held = np.zeros(len(w) + 1, int)
        for s in range(len(w) - words + 1):
            if seen[w[s : s + words]] > 1:
                held[s : s + words] = 1
        out.append(int((np.diff(np.concatenate([[0], held])) == 1).sum()))
    return out
