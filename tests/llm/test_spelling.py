"""Operator 12 against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from thalweg.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string"


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(x, y):
    """Written without the operator's idea: all ways to leave out or change a code point."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_variants(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for x in group:
            near[x] |= {y for y in group if y != x and one_edit(x, y)}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda y: (-words[y], y))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("split", [48, 2])
def test_sf(spark, monkeypatch, split):
    monkeypatch.setattr(sv, "SPLIT", split)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_variants(plain_words([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert len(want) > 500
    assert got(sv.variants(sv.counted(df))) == want


def test_dense_neighbours(spark, monkeypatch):
    """All words over two letters of three lengths, with chains of forms, doubled letters and longer words; every block is subdivided to the end."""
    monkeypatch.setattr(sv, "SPLIT", 3)
    words = {}
    for size in (6, 7, 8):
        for k in range(1 << size):
            words["".join("ab"[k >> i & 1] for i in range(size))] = 5 + (k * 7919 + size) % 400
    words |= {"x" * 80: 5, "x" * 81: 40, "x" * 40 + "y" + "x" * 39: 200, "élanées": 5, "elanées": 25, "elanees": 26, "elanee": 130, "ÀÀÀÀÀÀ": 7, "ÀÀÀÀÀ×": 35}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert got(sv.variants(df)) == plain_variants(words)


def test_long_chain(spark):
    """Roots by doubling follow the longest chain that counts allow."""
    word, words = "abcdefghijklm", {}
    for k in range(10):
        words[word] = 5**k * 5
        word = word[:k] + "z" + word[k + 1 :]
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r["word"]: r["root"] for r in sv.variants(df).collect()}
    assert set(rows.values()) == {max(words, key=words.get)}


def test_nulls_stretches_repeats(spark, monkeypatch):
    rows = [(1, None), (None, "Straßen straßen STRAßen " * 3), (2, ""), (3, "tïtles " * 400), (3, "tïtles " * 400), (4, "títles-titles_titles;" * 30), (5, "q" * 5000 + " ") ] + [(k, "q" * 5000) for k in range(6, 11)]
    want = plain_variants(plain_words(rows))
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA + ", word string, n long")
    assert got(sv.variants(sv.counted(df))) == want
    text = "".join(f"word{'abc'[k % 3]}ing " for k in range(500))
    monkeypatch.setattr(sv, "STRETCH", 7)
    assert [w for part in sv.runs(text) for w in part] == re.findall("[a-z]{6,}", text)


def test_empty(spark):
    assert got(sv.variants(sv.counted(spark.createDataFrame([], SCHEMA)))) == []
    assert got(sv.variants(sv.counted(spark.createDataFrame([(1, "few words only")], SCHEMA)))) == []
