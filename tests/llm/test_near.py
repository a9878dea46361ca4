"""Operators 5, 8 and 9 against brute force over all pairs."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thalweg.llm import _graph, _text, embedding_dedup, fingerprints, minhash_dedup


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def shingle_set(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_corpus(seed):
    r = random.Random(seed)
    say = lambda n: [f"{r.choice('abcdeé')}{r.randrange(400)}" for _ in range(n)]
    docs, d = {}, 0
    for _ in range(25):
        base = say(r.choice([3, 4, 5, 8, 20, 60, 200]))
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 20, len(w) // 10])):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            docs[d * 13 % 509] = r.choice([" ", "\n ", "\t"]).join(w).replace("a", r.choice("aA"))
            d += 1
    return docs | {1000: None, 1001: "", 1002: " \n", 1003: "one", 1004: "ONE", 1005: "É é", 1006: "a b c", 1007: "a b c"}


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 4), (3, 5)])
def test_minhash(spark, seed, size):
    docs = near_corpus(seed)
    sets = {d: shingle_set(t, size) for d, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(docs, links)
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(d, t, 1, 2) for d, t in docs.items()], "doc_id bigint, text string, n int, key int").repartition(3), size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {d: (len(sets[d]), root[d], root[d] == d) for d in docs}


def test_minhash_edges(spark):
    f = minhash_dedup.near_duplicates
    assert f(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    text = "a b c d e f g h i j"
    rows = f(spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text)], "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)]


def test_minhash_unlike_texts_of_one_id(spark):
    """Each row by its own text: a copy goes, an unlike text of the same doc_id stays."""
    say = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    a, b = say("a"), say("b")
    rows = [(0, a), (1, a), (1, b), (2, b + " x"), (3, say("c")), (3, say("d")), (4, say("d") + " y"), (5, say("d"))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False)]


def test_word_hashes_of_long_words():
    """Two long words that a polynomial modulo 2^64 can't tell apart, and slices of any size."""
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [thue, other, thue + " b " + other, "x " * 3000 + thue]
    data, offsets = _text.buffers(pa.array(texts))
    starts, ends, _ = _text.words(data, offsets)
    got = _text.word_hashes(data, starts, ends)
    words = [w for t in texts for w in t.split()]
    assert len(words) == len(got) and len(set(got.tolist())) == len(set(words)) == len(set(zip(words, got.tolist(), strict=True)))


def test_minhash_large_group(spark):
    """Copies with few and with many edits of one text: components as by brute force."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = {}
    for d in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(60)] = f"x{r.randrange(9999)}"
        docs[d] = " ".join(w)
    sets = {d: shingle_set(t, 4) for d, t in docs.items()}
    root = components(docs, [(a, b) for a in docs for b in docs if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3), 4).collect()
    assert len(set(root.values())) > 5 and {x.doc_id: x.component_id for x in rows} == root


def test_shared_counts(spark):
    r = random.Random(3)
    sets = {i: r.sample(range(400), 30) for i in range(40)}
    got = {x.id: x.shared for x in minhash_dedup.shared_counts(spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "id bigint, n bigint, prints array<bigint>").repartition(4)).collect()}
    words = {x.id: x.words for x in minhash_dedup.shared_counts(spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "id bigint, n bigint, prints array<bigint>")).collect()}
    for i, w in words.items():
        assert sum((x % 2**64).bit_count() for x in w[:-1]) + w[-1] == got[i]
    for i, s in sets.items():
        assert got.get(i, 0) == sum(any(x in t for j, t in sets.items() if j != i) for x in s)


def test_pigeonhole():
    """Every pair of signatures under the distance shares a key."""
    r = np.random.default_rng(1)
    m = minhash_dedup.CHUNKS * minhash_dedup.WIDTH
    for _ in range(200):
        a = r.integers(0, 1 << 16, m).astype(np.uint16)
        b = a.copy()
        b[r.choice(m, minhash_dedup.CHUNKS * (minhash_dedup.ERRORS + 1) - 1, replace=False)] ^= 1
        keys = minhash_dedup.chunk_keys(np.array([a, b]))
        assert set(keys[0]) & set(keys[1])


@pytest.mark.parametrize("piece", [200_000, 50])
def test_connected(spark, piece, monkeypatch):
    monkeypatch.setattr(_graph, "PIECE", piece)  # of the driver: how often the steps between pieces run
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    got = {x.id: x.component for x in _graph.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert _graph.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints(spark):
    docs = near_corpus(5) | {2000: "é" * 50, 2001: "word " * 300}
    rows = fingerprints.edited_fingerprints(spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id bigint, text string, part int").repartition(3)).collect()
    assert len(rows) == len(docs)
    order = sorted(docs, reverse=True)
    by, prints = {r.doc_id: r for r in rows}, {}
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = docs[d] or "", docs[after] or "", by[d]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, f) == f
        alike = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / fingerprints.PERMUTATIONS
        assert math.isclose(r.near_edited, alike(r.fingerprint, r.edited_fingerprint)) and math.isclose(r.near_next, alike(r.fingerprint, by[after].fingerprint))
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()} == {d: r.fingerprint for d, r in by.items()}


def test_fingerprint_edges(spark):
    f = fingerprints.edited_fingerprints
    assert f(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    (one,) = f(spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert len(f(spark.createDataFrame([(5, "x"), (5, "x"), (None, None), (None, "y")], "doc_id bigint, text string")).collect()) == 4


def test_fingerprints_of_a_shared_id(spark):
    """Very many rows of one doc_id or of none: dealt to several ranges, in one order."""
    r = random.Random(7)
    docs = [(i, f"text {i} " * r.randint(1, 9)) for i in range(40)] + [(17, f"other {i} words") for i in range(300)] + [(None, f"none {i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    ties = {(x.doc_id, x.text): x.h for x in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), ties[x]))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    got = fingerprints.edited_fingerprints(df)
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256) for x in got.collect()) == sorted(want)


def test_similar(spark):
    docs = near_corpus(6)
    sets = {d: {s for s in shingle_set(t, 5)} for d, t in docs.items()}
    raw = {d: {tuple(x) for x in zip(*[(t or "").split()[i:] for i in range(5)], strict=False)} for d, t in docs.items()}
    got = fingerprints.similar(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    assert got and all(r.leader < r.doc_id and 100 * len(sets[r.leader] & sets[r.doc_id]) >= 80 * len(sets[r.leader] | sets[r.doc_id]) for r in got)
    same = {d: min(o for o in docs if (docs[o] or "").split() == (docs[d] or "").split()) for d in docs if raw[d]}
    found = {r.doc_id for r in got}
    assert all(d in found for d, o in same.items() if d != o)


@pytest.mark.parametrize("percent", [80, 75])
def test_similar_in_a_loose_family(spark, percent):
    """Texts put together from a few common blocks, mostly unlike the leaders of their bands: near pairs as by brute force."""
    r = random.Random(11)
    blocks = [[f"w{b}-{i}" for i in range(40)] for b in range(12)]
    docs = {}
    for i in range(250):
        words = [w for b in sorted(r.sample(range(12), 6)) for w in blocks[b]]
        docs[i] = " ".join(words)
        if i % 3 == 0:
            for at in r.sample(range(len(words)), 3):
                words[at] = f"x{r.randrange(99999)}"
            docs[i + 1000] = " ".join(words)
    sets = {d: shingle_set(t, 5) for d, t in docs.items()}
    near = {d: {o for o in docs if o < d and 100 * len(sets[o] & sets[d]) >= percent * len(sets[o] | sets[d])} for d in docs}
    got = {x.doc_id: x.leader for x in fingerprints.similar(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3), percent).collect()}
    assert all(leader in near[d] for d, leader in got.items())
    want = {d for d, others in near.items() if others}
    assert len(want) > 40 and len(want & got.keys()) >= 0.98 * len(want)


def vectors(seed, n=400, d=24):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((30, d))
    x = np.concatenate([r.standard_normal((n // 2, d)), centres[r.integers(0, 30, n // 2)] + r.standard_normal((n // 2, d)) * r.choice([0.02, 0.1, 0.3], (n // 2, 1))]).astype(np.float32)
    x[5], x[6] = x[7], x[7] * 2
    return x


@pytest.mark.parametrize("block", [2000, 20])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = vectors(1)
    x[50:120] = x[50] + np.random.default_rng(2).standard_normal((70, 24)).astype(np.float32) * 0.01
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [None] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] * 24), (1005, []), (1006, [1.0, 2.0]), (1007, [1.0, 2.0])]
    rows = embedding_dedup.embedding_near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(i, v, 0) for i, v in odd], "vec_id bigint, embedding array<float>, label int").repartition(3)).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    want = {i: 0 for i in range(len(x))}
    for a, b in links:
        want[a] += 1
        want[b] += 1
    assert len(rows) == len(x) + 8
    assert all(got[i][0] <= n for i, n in want.items())  # none below the threshold
    assert sum(got[i][0] for i in want) >= 0.997 * sum(want.values())
    root = components(range(len(x)), links)
    assert np.mean([got[i][1] == root[i] for i in root]) > 0.99
    assert {i: got[i] for i in range(1000, 1006)} == {i: (0, i, True) for i in range(1000, 1006)}
    assert got[1006] == (1, 1006, True) and got[1007] == (1, 1006, False)


def test_forest():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (300, 290), (300, 2000)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        root = components(range(n), list(zip(a.tolist(), b.tolist(), strict=True)))
        assert _graph.roots(a, b, n).tolist() == [root[i] for i in range(n)]


def test_estimate_is_unbiased():
    r = np.random.default_rng(3)
    a, b = (embedding_dedup.unit_rows(r.standard_normal((300, 64))) for _ in range(2))
    b = embedding_dedup.unit_rows(a + 0.5 * b)
    packed, factor = embedding_dedup.codes(a)
    about, error = embedding_dedup.estimates(packed, factor, b)
    exact = np.einsum("ij,ij->i", a, b)
    off = (np.diag(about) - exact) / error
    assert abs(off.mean()) < 0.25 and np.abs(off).max() < embedding_dedup.Z + 1


def test_embedding_edges(spark):
    assert embedding_dedup.embedding_near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
