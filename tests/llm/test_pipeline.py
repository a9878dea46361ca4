"""Every stage of the pipeline against plain Python, on the smallest tables."""

import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thalweg.llm import mixing, packing, secret_scan, toxicity

from .test_near import components, shingle_set
from .test_scoring import brute_pack

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).checkpoint()
        out.append(docs.collect())
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    matcher = toxicity.Matcher(toxicity.learn_lexicon(frame(spark, stages[0]), labels))
    assert sorted(stages[1]) == sorted(r for r in stages[0] if matcher.score(r.text) < toxicity.THRESHOLD)


def test_near_duplicate_stage(stages):
    sets = {r.doc_id: shingle_set(r.text, 5) for r in stages[1]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert links and sorted(stages[2]) == sorted(r for r in stages[1] if root[r.doc_id] == r.doc_id)


def test_secret_stage(spark, stages):
    model, want = secret_scan.fit(frame(spark, stages[2])), []
    for r in stages[2]:
        text, shift = r.text, 0
        for a, b, rule in secret_scan.candidates(r.text or ""):
            value, end = r.text[a:b], b
            if rule == "private_key":
                end = a + re.match(secret_scan.PATTERNS["private_key"], value).end()
            p = model.predict([(r.text[a:end], rule, r.source or "", r.text[max(0, a - 40) : a], r.text[end : end + 40])])[0]
            if round(p, 6) >= 0.5:
                text = text[: a + shift] + f"[{rule}]" + text[b + shift :]
                shift += len(rule) + 2 - (b - a)
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert sorted(map(str, map(tuple, stages[3]))) == sorted(map(str, want))


def test_mixing_stage(spark, stages):
    docs = frame(spark, stages[3])
    labels = mixing.by_quality(spark.read.parquet(f"{SF}/labels.parquet"))
    rate = {r.doc_id: r.rate for r in mixing.weigh(docs, labels).collect()}
    chance = {r.doc_id: (r.h % (1 << 30)) / (1 << 30) for r in docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()}
    want = []
    for r in stages[3]:
        whole = math.floor(rate[r.doc_id])
        want += [tuple(r)] * (whole + (chance[r.doc_id] < rate[r.doc_id] - whole))
    assert sorted(map(str, map(tuple, stages[4]))) == sorted(map(str, want)) and len(want) > 50


def test_packing_stage(spark, stages):
    hashed = {(x.doc_id, x.text): x.h for x in frame(spark, stages[4]).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    rows, seen = [], {}
    for r in stages[4]:
        copy = seen[r.doc_id] = seen.get(r.doc_id, -1) + 1
        n, most = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), packing.CAPACITIES[-1]
        rows += [{"doc_id": r.doc_id, "text_id": hashed[r.doc_id, r.text], "copy": copy, "piece": i, "piece_tokens": min(most, n - i * most)} for i in range(-(-n // most))]
    got = sorted((x.doc_id, x.piece, x.bin_offset, x.bin_size) for x in stages[5] if x.bin_id is not None)
    assert got == brute_pack(rows, 1, lambda x: 0) and len(stages[5]) >= len(rows)


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5]))
