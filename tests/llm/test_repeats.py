"""Operators 1 and 4 against brute force over every window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import _windows
from thalweg.llm.substring_dedup import SuffixAutomaton, substring_dedup
from thalweg.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id bigint, text string, source string, gram bigint, bucket int"


def brute_bytes(docs, window=100):
    seen, out = {}, {}
    for d, t in sorted(docs.items()):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = [True] * window
            else:
                seen[w] = 1
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def brute_words(docs, window=35):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in docs.items()}
    count = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [say(r.randint(20, 90)) for _ in range(5)]
    docs = {}
    for d in range(60):
        w = say(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "edit"
            w += p + say(r.randint(0, 20))
        docs[d * 7 % 61] = r.choice([" ", "  ", "\n"]).join(w)
    docs |= {100: None, 101: "", 102: "a" * 350, 103: "ab " * 200, 104: docs[3], 105: docs[3], 106: " ".join(say(40)) + " " + "x y " * 60, 107: "zz", 108: "w " * 34, 109: "w " * 35, 110: "\x00" * 150}
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    rows = suffix_dedup(spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs.items()], SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_bytes(docs)


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed):
    docs = corpus(seed)
    rows = substring_dedup(spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs.items()], SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_words(docs)


@pytest.mark.parametrize("f, brute", [(suffix_dedup, brute_bytes), (substring_dedup, brute_words)])
def test_hot_gram(spark, f, brute, monkeypatch):
    """A line that many documents continue in their own ways."""
    r = random.Random(9)
    say = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    line, ends = say(30), [say(9) for _ in range(40)]
    docs = {d: f"{say(r.randint(0, 9))} {line} {r.choice(ends)} {say(5)}" for d in range(700)}
    rows = f(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == brute(docs)


@pytest.mark.parametrize("f, brute, tokens, window, k, both", [(suffix_dedup, brute_bytes, _windows.byte_tokens, 100, 32, False), (substring_dedup, brute_words, _windows.word_tokens, 35, 12, True)])
def test_frequent_line_is_spread(spark, f, brute, tokens, window, k, both):
    """A line that a third of the texts continue in their own ways, and a text that many repeat: no bucket has more than twice the mean, and the result is that of brute force."""
    r = random.Random(3)
    say = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    line, same = say(60), say(90)
    docs = {d: f"{say(20)} {line} {say(30)}" if d % 3 == 0 else same if d % 3 == 1 else say(70) for d in range(1500)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    rows = df.select(F.col("doc_id").alias("key"), "text")
    frequent = _windows.frequent_grams(rows, len(docs), tokens, window, k, 16)
    assert 0 < len(frequent) < 50
    ids = _windows.bucket_ids(spark, 16)
    size = {n: 0 for n in ids.tolist()}
    for x in _windows._runs(rows, tokens, window, k, ids, both, frequent).select("bucket", F.size(F.filter("copies", lambda c: c > 0)).alias("n")).collect():
        size[x["bucket"]] += x["n"]
    assert max(size.values()) <= 2 * sum(size.values()) / len(size)
    assert {x[0]: tuple(x)[1:] for x in f(df).collect()} == brute(docs)


def test_bucket_ids(spark):
    ids = _windows.bucket_ids(spark, 31).tolist()
    assert len(set(ids)) == 31
    rows = spark.createDataFrame([(i,) for i in ids], "bucket int").repartition(31, "bucket")
    assert rows.select(F.spark_partition_id()).distinct().count() == 31


@pytest.mark.parametrize("f", [suffix_dedup, substring_dedup])
def test_edges(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = f(spark.createDataFrame([(1, text, "s", 1, 1), (1, text, "s", 1, 1), (None, text, None, None, None)], SCHEMA)).collect()
    assert len(rows) == 3 and all(r.n_removed == 0 for r in rows)  # one document, and one that is not compared


@pytest.mark.parametrize("f, brute", [(suffix_dedup, brute_bytes), (substring_dedup, brute_words)])
def test_unlike_texts_of_one_doc_id(spark, f, brute):
    """Each text is judged by itself; brute force takes them as documents in the operator's order."""
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(3, say(0, 200)), (5, say(50, 180)), (5, say(1000, 1200)), (5, say(1100, 1150) + " end"), (9, say(1000, 1060)), (5, None), (5, say(50, 180)), (2, "short"), (None, say(0, 200)), (None, say(0, 200))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = df.filter("doc_id is not null").distinct().orderBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    want = brute({k: r["text"] for k, r in enumerate(order)})
    per_row = {(r["doc_id"], r["text"]): want[k] for k, r in enumerate(order)}
    alone = brute({0: say(0, 200)})[0]
    got = sorted(((r[0], *tuple(r)[1:]) for r in f(df).collect()), key=repr)
    assert got == sorted(((i, *(per_row[i, t] if i is not None else alone)) for i, t in rows), key=repr)


def test_automaton():
    r = random.Random(5)
    for _ in range(40):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 25))) for _ in range(4)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(list(t))
        a.count_places()
        n = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
        for t in texts:
            assert a.repeated_ends(list(t), 3) == [i + 3 for i in range(len(t) - 2) if n[t[i : i + 3]] > 1]


def test_settled_neighbours_travel_as_one_run():
    cells = [(7, 3, 1), (7, 0, 2), (7, 2, 1), (7, 9, 1), (8, 4, 2), (8, 7, 1)]
    runs = {k: np.array(v, np.int64) for k, v in zip(("doc", "start", "n"), zip(*cells, strict=True), strict=True)}
    joined = _windows._joined(runs)
    assert list(zip(*(joined[k].tolist() for k in ("doc", "start", "n")), strict=True)) == [(7, 0, 4), (7, 9, 1), (8, 4, 2), (8, 7, 1)]
    assert len(_windows._joined({k: v[:0] for k, v in runs.items()})["n"]) == 0


def test_long_rows_in_stretches():
    """A long row gives the same windows, whatever the length of its stretches."""
    from thalweg.llm import _windows

    codes = np.random.default_rng(3).integers(0, 3, 4000).astype(np.uint64)
    bounds = np.array([0, len(codes)])
    whole, parts = _windows.runs_of(codes, bounds, 40, 12), _windows.runs_of(codes, bounds, 40, 12, 500)
    each = lambda runs: {s + i: g for s, n, g in zip(runs["start"].tolist(), runs["n"].tolist(), runs["gram"].tolist(), strict=True) for i in range(n)}
    assert each(whole) == each(parts) and len(each(whole)) == 4000 - 39 == int(parts["n"].sum())
