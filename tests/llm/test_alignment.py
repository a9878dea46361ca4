"""Operator 11 against plain Python."""

import hashlib
import json
from collections import Counter, defaultdict

import pytest

from thalweg.llm import token_alignment as ta

A_FILE, B_FILE = f"{ta.TOKENIZERS}/byte_bpe_50k.json", f"{ta.TOKENIZERS}/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string"


def plain_tokens(texts):
    """Per text two lists of (id, bytes), or none; whole texts, no units."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    name = {i: t for t, i in json.load(open(A_FILE))["model"]["vocab"].items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        x = [(i, bytes(of[c] for c in name[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        out.append((x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else None)
    return out


def plain(texts):
    docs, count = [], Counter()
    for found in plain_tokens(texts):
        if found is None:
            docs.append(None)
            continue
        ends = []
        for side in found:
            at, e = 0, []
            for _, t in side:
                at += len(t)
                e.append(at)
            ends.append(e)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            g = ([], [])
            while i < len(ends[0]) and ends[0][i] <= cut:
                g[0].append(found[0][i][0])
                i += 1
            while j < len(ends[1]) and ends[1][j] <= cut:
                g[1].append(found[1][j][0])
                j += 1
            groups.append(g)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        count.update(links.keys())
        docs.append((len(ends[0]), len(ends[1]), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in d[2])
        out.append((d[0], d[1], len(d[2]), sum(d[3].values()), sum(n for k, n in d[3].items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in d[3].items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in ta.alignment_digests(df).collect()), key=repr)
    want = sorted(((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]), strict=True)), key=repr)
    assert got == want


TEXTS = [
    "The quick brown fox", "The quick brown fox", "", None, " ", "  two  spaces\n\n and lines \t tab ", "naïve café ▁ block", "日本語の文章 and 한국어 \U0001f600\U0001f1eb\U0001f1f7",
    "<|endoftext|> <s> <unk> </s> <0x41>", "don't we'll I'm", " nbsp   x　y z", "a᠎ b", "x" * 300, "antidisestablishmentarianism 1234567890 !!!???", "\x00 nul \x1c sep", "é combining",
]


def test_small(spark):
    check(spark, list(enumerate(TEXTS)))


def test_nulls_ties_repeats(spark):
    check(spark, [(None, "no id here"), (None, "no id here"), (3, "same row"), (3, "same row"), (3, "another text of three"), (4, None), (5, "▁")])


def test_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_stretches_and_wide_groups(spark, monkeypatch):
    """Documents of many blocks, groups wider than a piece: the same as whole. (Workers fork from this process's values by pickling the module's functions.)"""
    words = " ".join(f"word{i % 97} thing{i % 31}" for i in range(400))
    texts = [words, "y" * 5000 + " end", "ab " * 700, "éè" * 900, "short"]
    whole = plain(texts)
    sides = ta._sides(open(A_FILE).read(), open(B_FILE, "rb").read())
    for stretch, piece, links, wide in ((40, 64, 32, 8), (1000, 50, 1 << 10, 4), (1 << 19, 1 << 20, 1 << 21, 1 << 12)):
        for k, v in (("STRETCH", stretch), ("PIECE", piece), ("LINKS", links), ("WIDE_GROUP", wide)):
            monkeypatch.setattr(ta, k, v)
        into = ta.Digests(tuple(len(s.vocabulary.lengths) for s in sides))
        machine = ta.Machine(*(s.vocabulary.lengths for s in sides), into.finish)
        for key, text in enumerate(texts):
            units, place = ta.Units(sides), 0
            for part in ta._stretches(text, True):
                numbers = units.look_up(ta._BETWEEN.split(part))
                assert units.ok[numbers].all()
                for side in (ta.A, ta.B):
                    n = units.bounds[side][1:] - units.bounds[side][:-1]
                    machine.add(key, key, side, units.ids[side][ta.ranges(units.bounds[side][numbers], n[numbers])])
                place += 1
        machine.flush()
        into.end_chunk()
        row = into.take()[0].to_pylist()[0]
        got = list(zip(*(row[c] for c in (*COLUMNS[:4], "groups_sha256")), strict=True))
        assert got == [(*w[:4], w[6]) for w in whole]


def test_very_long_text(spark):
    """A text of several stretches, in Spark, beside short ones and a long run without spaces."""
    words = " ".join(f"word{i * 7919 % 9973} thing{i % 31}," for i in range(40_000))
    assert len(words) > ta.STRETCH
    check(spark, [(1, words), (2, "short"), (3, "z" * 3000), (4, words[:1000])])


def test_groups(spark):
    """align() gives the groups themselves."""
    df = spark.createDataFrame([(1, "The antidisestablishment fox"), (2, None)], SCHEMA)
    rows = {r["doc_id"]: r for r in ta.align(df).collect()}
    assert rows[2]["a_ids"] == [] and rows[2]["b_ends"] == []
    x, y = plain_tokens(["The antidisestablishment fox"])[0]
    assert rows[1]["a_ids"] == [i for i, _ in x] and rows[1]["b_ids"] == [i for i, _ in y]
    for e, f in zip(rows[1]["a_ends"], rows[1]["b_ends"], strict=True):
        assert b"".join(t for _, t in x[:e]) == b"".join(t for _, t in y[:f])


@pytest.mark.parametrize("rows", [[], [(1, "x")]])
def test_empty_and_extra_columns(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "k", 9) for i, t in rows], SCHEMA + ", chunk long, key string, pair long")
    assert ta.alignment_digests(df).count() == len(rows)
