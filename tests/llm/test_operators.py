"""The operators against brute force, on inputs with every awkward case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.llm import decontaminate, linededup, neardup, packing, suffixes, toxicity
from nearloom.llm.tokens import Encoder
from tests.llm import brute


def sha(c):
    return F.sha2(c, 256)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_line_dedup(docs, awkward):
    done = linededup.line_dedup(docs)
    assert done.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set(done.columns) == {*docs.columns, "n_dropped"}
    assert rows_of(done.select("doc_id", "n_lines", "n_dropped", sha("text"))) == sorted(brute.line_dedup(awkward), key=repr)
    assert linededup.line_dedup(docs.limit(0)).count() == 0


ITEMS = [(1, None), (2, ""), (3, "one"), (4, "Shared line that recurs often"), (4, "Shared line that recurs often"), (5, "!!!"), (None, "own line 2 of this document")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 7])
def test_decontamination(spark, docs, awkward, block):
    items = [*ITEMS, (9, " ".join(awkward[6][1].split()[100:140]))]
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block=block)
    got = rows_of(found.select("doc_id", "n_words", "n_hit", F.size("items"), sha(F.concat_ws(",", "items")), "contaminated"))
    want = brute.contamination(awkward, [(i, t) for i, t in items])
    named = [w for w in want]
    # an item without an id has windows but no name
    fixed = []
    for w, (i, t) in zip(named, awkward, strict=True):
        held = sorted({str(a) for a, b in items if a is not None and brute.contamination([(i, t)], [(a, b)])[0][5]})
        fixed.append((w[0], w[1], w[2], len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), w[5]))
    assert got == sorted(fixed, key=repr)


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs, none).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("batches,hot,slice_", [(1, 4096, 1 << 20), (3, 4096, 700), (2, 1, 1 << 20)])
def test_repeats(docs, awkward, monkeypatch, batches, hot, slice_):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    done = suffixes.remove_repeats(docs, batches=batches)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    done = done.cache()
    assert rows_of(done.select("doc_id", "n_bytes", removed, F.size("spans"), sha("kept"))) == sorted(brute.repeats(awkward), key=repr)
    want = [(i, n) for (i, _), n in zip(awkward, brute.passages(awkward), strict=True)]
    assert rows_of(done.select("doc_id", "n_passages")) == sorted(want, key=repr) and sum(n for _, n in want) > 5


def test_index_family_merges_levels(spark, docs):
    keyed = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    family = suffixes.IndexFamily()
    sizes = []
    for b in range(5):
        family.add(keyed.where(F.pmod("k2", F.lit(5)) == b))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, awkward, k):
    got = neardup.near_duplicates(docs, k=k).collect()
    want = brute.components([(i, t) for i, t in awkward if i is not None], k)
    assert len(got) == len(awkward)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    sizes = {i: len(brute.shingles(t, k)) for i, t in awkward}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_chain_of_near_copies_in_one_bucket(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*(f"x{j}" for j in range(8 * i)), *words[8 * i :]])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == brute.components(rows, 2)


def family(seed, many, planted, step=2, p=13, near=18):
    """Versions of one text, none linked with another; every ``planted``-th has a near copy, linked with it alone.

    In segment s of step * p words version i has a word of its own at step times a quadratic in s modulo p,
    so two versions agree in two of their own places at most.
    """
    r = random.Random(seed)
    rows, pairs = [], []
    for i in range(many):
        text = [f"w{j}" for j in range(step * p * p)]
        own = [step * p * s + step * ((i % p + i // p % p * s + i // p // p * s * s) % p) for s in range(p)]
        for j in own:
            text[j] = f"x{i}y{j}"
        rows.append((2 * i, " ".join(text)))
        if i % planted == 0:
            for j in r.sample([j for j in range(0, step * p * p, step) if j not in own], near):
                text[j] = f"z{i}y{j}"
            rows.append((2 * i + 1, " ".join(text)))
            pairs.append((2 * i, 2 * i + 1))
    r.shuffle(rows)
    return rows, pairs


def test_no_link_is_lost_in_a_large_group_of_versions(spark):
    rows, pairs = family(1, 700, 10)
    texts = dict(rows)
    for a, b in pairs:
        x, y = (brute.shingles(texts[i], 2) for i in (a, b))
        assert 100 * len(x & y) >= 80 * len(x | y)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=2).collect()}
    assert all(got[a] == a == got[b] for a, b in pairs) and len(set(got.values())) == 700


@pytest.mark.parametrize(("large", "block", "shared"), [(64, 1024, 4), (2, 3, 4), (2, 1024, 1), (8, 20, 9)])
def test_the_rest_is_exact_without_stars(spark, monkeypatch, awkward, large, block, shared):
    rows = family(2, 60, 3)[0] + [(1000 + i, t) for i, t in awkward if i is not None]
    for name, value in (("LARGE", large), ("BLOCK", block), ("SHARED", shared)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(neardup, "_first_stars", lambda buckets: buckets.select(F.col("id").alias("a"), F.col("id").alias("b")).where("a <> b"))
    monkeypatch.setattr(neardup, "_later_stars", lambda rows: rows.select(F.col("id").alias("a"), F.col("id").alias("b")).where("a <> b"))
    for k in (2, 5):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
        assert got == brute.components(rows, k)


def test_filters_let_no_link_go():
    g = np.random.default_rng(3)
    for n in (1, 4, 5, 9, 60, 700, 30_000):
        for _ in range(20):
            common, more = g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), g.integers(0, n // 4 + 1, 2)
            if more.sum() > n // 4:
                more = more // 2
            a, b = (np.unique(np.concatenate([common, g.integers(0, 1 << 63, m, dtype=np.uint64)])) for m in more)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = (np.frombuffer(neardup.counts(v), np.uint8) for v in (a, b))
                assert neardup.reachable(x[None], y[None], np.array([len(a)]), np.array([len(b)]), 80)[0]
                listed = np.sort(g.choice(common, n // 2, False))
                frequent = listed, g.integers(2, 9, len(listed))
                p, q = (neardup.prefix(v, frequent, 80) for v in (a, b))
                assert len(np.intersect1d(p, q)) >= min(neardup.SHARED, both)
    x, y = (np.frombuffer(neardup.counts(g.integers(0, 1 << 63, 300, dtype=np.uint64)), np.uint8) for _ in range(2))
    assert not neardup.reachable(x[None], y[None], np.array([300]), np.array([300]), 80)[0]


def test_sketches_merge_and_estimate():
    g = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        common, n = g.integers(0, 1 << 63, 1000, dtype=np.uint64), int(1000 * (1 - share) / (2 * share))
        a, b = (np.concatenate([common, g.integers(0, 1 << 63, n, dtype=np.uint64)]) for _ in range(2))
        x, y = (np.frombuffer(neardup.sketch(v), "<u2") for v in (a, b))
        assert (np.maximum(x, y) == np.frombuffer(neardup.sketch(np.concatenate([a, b])), "<u2")).all()
        assert neardup.possible(x[None], y[None], np.array([len(a)]), np.array([len(b)]), 0.8)[0] or share < 0.7
    far = np.frombuffer(neardup.sketch(g.integers(0, 1 << 63, 900, dtype=np.uint64)), "<u2")
    assert not neardup.possible(x[None], far[None], np.array([1000]), np.array([900]), 0.8)[0]


def test_packing(docs, awkward):
    rows = [r.asDict() for r in packing.pack(docs).collect()]
    encoder, want = Encoder(), []
    for i, t in awkward:
        ids = np.frombuffer(encoder.encode(t or "") + b"\0\0\0\0", "<u4")
        assert ids[:-1].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
        want += [(i, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)]
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 1024 and packing.pack(docs.limit(0)).count() == 0


def test_special_token_strings_and_white_space():
    encoder = Encoder()
    for t in ["<|endoftext|> a", "a  b", " a", "a ", "a \n b", "a\u00a0 b", "'s 'll x'S", "\t\t\n x", "日本 語", "a" * 3000]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_best_fit_against_a_scan():
    g = np.random.default_rng(2)
    lengths = sorted(g.integers(1, 65, 300).tolist(), reverse=True)
    room, fill = [], []
    for n in lengths:
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(64 - n)
        else:
            room[room.index(fit)] -= n
        fill.append(n)
    spots = packing.best_fit(lengths, 64)
    used = {}
    for (which, offset), n in zip(spots, lengths, strict=True):
        assert used.get(which, 0) == offset
        used[which] = offset + n
    assert len(used) == len(room) and sorted(64 - v for v in used.values()) == sorted(room)


def test_plan_of_counts_is_best_fit_decreasing():
    g = np.random.default_rng(4)
    for window, n, most in ((64, 900, 65), (64, 5, 65), (1024, 4000, 1025), (50, 700, 12), (7, 0, 8)):
        lengths = np.sort(g.integers(1, most, n))[::-1]
        values, counts = np.unique(lengths, return_counts=True)
        plan = packing.Plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), window)
        rank = np.concatenate([np.arange(c) for c in counts[::-1]]) if n else np.zeros(0, int)
        sequence, offset = plan.place(lengths, rank)
        used = {}
        for s, o, k in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
            assert used.get(s, 0) == o
            used[s] = o + k
        want = {}
        for (s, o), k in zip(packing.best_fit(lengths.tolist(), window), lengths.tolist(), strict=True):
            want[s] = max(want.get(s, 0), o + k)
        assert sorted(used.values()) == sorted(want.values()) and set(used) == set(range(plan.made))


def test_packing_does_not_depend_on_partitions(spark, docs):
    made = {packing.pack(docs.repartition(n)).agg(F.max("sequence_id")).first()[0] for n in (1, 3, 7)}
    assert len(made) == 1


def test_toxicity(spark, sf_dir, docs):
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels)
    done = toxicity.score(docs, model)
    assert done.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    got = done.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_text = {}
    for r in got:
        assert abs(by_text.setdefault(r.text or "", r.score) - r.score) < 1e-4
    assert toxicity.fit(d, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    split = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in split.items())


def test_only_links_come_back_from_large_buckets(spark, monkeypatch):
    """Versions just below the threshold: their pairs grow with the square of the group, those to confirm must not."""
    rows, pairs = family(4, 400, 20)
    rest, found = neardup._rest, []

    def counted(*of):
        out = rest(*of)
        found.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_rest", counted)
    neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=2)
    assert found[0] <= 2 * len(pairs)


def test_most_shared_is_never_too_low():
    g = np.random.default_rng(6)
    pool = g.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    pool[:900] = pool[:900] % np.uint64(1 << 50)  # many of one class
    sets = [np.unique(g.choice(pool, n)) for n in (1, 2, 50, 900, 3000, 3000)]
    classes = [np.frombuffer(neardup.folded(x), "<u2") for x in sets]
    nths = [neardup.nth(c) for c in classes]
    for x, c in zip(sets, classes, strict=True):
        want = np.array([len(np.intersect1d(x, y)) for y in sets])
        got = neardup.most_shared(c, classes, nths)
        assert (got >= want).all() and (got <= np.minimum(len(x), [len(y) for y in sets])).all()
        assert (got - want).max() <= 950 and neardup.most_shared(c, [c], [neardup.nth(c)])[0] == len(x)
