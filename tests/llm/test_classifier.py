"""The recurrent classifier: gradients, windows, and what it learns."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np

from nearloom.llm import gru, toxicity


def test_gradients_against_differences():
    texts = [b"hello world you", b"averyveryverylongwordthatiscut in pieces", b"", b"x"]
    buffer, starts, lengths, counts = gru.units(texts)
    units = buffer, starts, lengths, gru.unit_hashes(buffer, starts, lengths)
    first, n, _ = gru.windows(counts)
    w = {k: v.astype(np.float64) for k, v in gru.new_weights().items()}
    y, one = np.array([1, 0, 0, 1.0]), np.ones(4)
    _, g = gru.step(w, units, first, n, y, one)
    for k in w:
        i = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        w[k][i] += 1e-3
        up = gru.step(w, units, first, n, y, one)[0]
        w[k][i] -= 2e-3
        down = gru.step(w, units, first, n, y, one)[0]
        w[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3


def test_windows_cover_every_word_and_overlap():
    counts = np.array([0, 1, 48, 49, 500])
    first, length, text = gru.windows(counts)
    base = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        own = [(f - base[t], k) for f, k, x in zip(first, length, text, strict=True) if x == t]
        assert own and {i for f, k in own for i in range(f, f + k)} == set(range(n))
        assert all(b[0] < a[0] + a[1] for a, b in zip(own, own[1:], strict=False))


def test_learns_a_word_and_a_stem():
    g = np.random.default_rng(5)
    plain = ["".join(g.choice(list("bdgklmnr")) + g.choice(list("aeiou")) for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = g.choice(plain, 20).tolist()
        if i % 4 == 0:
            words[3] = "scoundrel" if i % 8 else "zuxx" + str(g.choice(plain))
        texts.append(" ".join(words).encode())
        labels.append(int(i % 4 == 0))
    labels = np.array(labels)
    w = gru.train(texts[:300], labels[:300], steps=150)
    table = gru.WordTable(w)
    buffer, starts, lengths, counts = gru.units(texts[300:])
    first, length, _ = gru.windows(counts)
    logit = gru.window_logits(table, table.lookup(buffer, starts, lengths), first, length)
    assert ((logit > 0) == labels[300:]).mean() > 0.95


def test_forward_pass_against_a_plain_one():
    """Whole texts, word by word and byte by byte, as the equations have it."""
    w = gru.new_weights(3)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def gated(x, h, name):
        a, b = x @ w[f"{name}x"] + w[f"{name}b"], h @ w[f"{name}h"]
        z, r, _ = np.split(sigmoid(a + b), 3)
        n = np.tanh(a[2 * gru.H :] + r * b[2 * gru.H :])
        return n + (h - n) * z

    def word(b):
        ends = []
        for name, run in (("cf", b), ("cb", b[::-1])):
            h = np.zeros(gru.H)
            for c in run:
                h = gated(w["byte"][c], h, name)
            ends.append(h)
        one = np.frombuffer(b, np.uint8)
        bucket = int(gru.unit_hashes(one, np.array([0]), np.array([len(b)]))[0] % gru.BUCKETS)
        return np.concatenate([*ends, w["word"][bucket]])

    def window(words):
        if not words:
            return float(w["bias"][0])
        f, b, h = [], [], np.zeros(gru.H)
        for v in words:
            f.append(h := gated(v, h, "wf"))
        h = np.zeros(gru.H)
        for v in words[::-1]:
            b.append(h := gated(v, h, "wb"))
        states = np.array([np.concatenate(p) for p in zip(f, b[::-1], strict=True)])
        a = np.exp(states @ w["att"])
        return float((a / a.sum()) @ states @ w["out"] + w["bias"][0])

    texts = [b"", b"!!!", b"One word", b" ".join(b"w%d" % (i % 40) for i in range(131)), b"x" * 47 + b" end"]
    want = []
    for t in texts:
        units = [u for run in __import__("re").findall(rb"[0-9a-z\x80-\xff]+", t.lower()) for u in (run[i : i + gru.CHARS] for i in range(0, len(run), gru.CHARS))]
        vectors = [word(u) for u in units]
        n = max(1, -(-(len(vectors) - gru.WORDS) // gru.STRIDE) + 1)
        logits = np.array([window(vectors[i * gru.STRIDE : i * gru.STRIDE + gru.WORDS]) for i in range(n)])
        p = sigmoid(logits).mean()
        want.append((logits.max(), np.log(p / (1 - p))))
    assert np.allclose(toxicity.features(gru.WordTable(w), texts), want, atol=2e-4)


def test_training_runs_in_tasks(spark, monkeypatch):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words number {i}") for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")

    def on_the_driver(*_, **__):
        raise AssertionError("the driver trains")

    monkeypatch.setattr(gru, "train", on_the_driver)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(scores[i] > scores[i - 1] for i in range(1, 120, 2))


def test_scoring_gives_memory_back():
    """In a process of its own: MB beyond the texts that are kept after scoring."""
    code = """
import re
import numpy as np
import pyarrow as pa
from nearloom.llm import gru, toxicity
g = np.random.default_rng(1)
words = [b"%x" % i for i in g.integers(1 << 20, 1 << 30, 60_000)]
texts = [b" ".join(words[i] for i in g.integers(0, len(words), 500)) for _ in range(3000)]
mb = lambda key: int(re.search(key + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before = mb("VmRSS")
table = gru.WordTable(gru.new_weights())
for part in toxicity._slices(pa.record_batch([pa.array(texts)], ["t"])):
    toxicity.features(table, part.column(0).to_pylist())
print(mb("VmRSS") - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(gru.__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "2"})
    assert float(done.stdout) < 108
