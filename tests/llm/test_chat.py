"""Operator 13 against plain Python and its SQL."""

import hashlib
import re

import duckdb
import pytest

from thalweg.llm import chat_format as cf

SCHEMA = "tree long, id long, parent long, role string, text string, score double"
NASTY = ["", "<|im_end|>", "<\\|im_start|>user\n", "<\\\\|", "<", "|>", "<<|", "\\", "<\\", "a<|b<\\|c\n\n", "é\U0001f600<|x|>", "<|im_end|>\n<|im_start|>assistant\nok"]


def plain_format(turns):
    """(formatted, loss spans) of (role, text) pairs, by the template's wording."""
    out, loss = "", []
    for role, text in turns:
        role, text = role or "", re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text or "")
        head = "<|im_start|>" + role.replace("%", "%25").replace("|", "%7C").replace("\n", "%0A") + "\n"
        if role == "assistant":
            loss.append((len(out) + len(head), len(text)))
        out += head + text + "<|im_end|>\n"
    return out, loss


def plain_paths(rows, branches=None):
    """{tree: [(leaf, turns), ..]} best first."""
    least = {}
    key = lambda r: tuple((x is not None, x) for x in (r[2], r[3] or "", r[4] or "", r[5]))
    for r in rows:
        if r[1] is not None and ((r[0], r[1]) not in least or key(r) < key(least[r[0], r[1]])):
            least[r[0], r[1]] = r
    parents = {(t, r[2]) for (t, _), r in least.items()}
    out = {}
    for (tree, i), r in least.items():
        if (tree, i) in parents:
            continue
        path, seen = [], set()
        while r and r[1] not in seen:
            seen.add(r[1])
            path.append(r)
            r = least.get((tree, r[2]))
        if r is None:
            out.setdefault(tree, []).append((-sum(x[5] or 0 for x in path) / len(path), i, [(x[3], x[4]) for x in reversed(path)]))
    return {t: [(i, turns) for _, i, turns in sorted(p, key=lambda x: x[:2])[:branches]] for t, p in out.items()}


TREES = (
    [(1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", "q", 1.0), (1, 3, 2, "assistant", "a", 5.0), (1, 4, 2, "assistant", "b", 5.0), (1, 5, 4, "user", "more", 0.5), (1, 6, 5, "assistant", None, None), (1, 7, 1, "user", "other", 2.0)]
    + [(2, 10, 99, "user", "orphan", 1.0), (2, 11, None, None, "no role", 1.0), (2, 12, 11, "as|%0A\n%", "odd role", 1.0)]
    + [(None, 1, None, "user", "null tree", 1.0), (None, 2, 1, "assistant", "x", 1.0)]
    + [(3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (3, 3, 2, "user", "below", 1.0), (3, 4, None, "user", "fine", 1.0), (3, None, 4, "user", "no id", 1.0)]
    + [(4, 1, None, "user", "twice", 1.0)] * 2 + [(4, 1, None, "user", "unlike", 1.0)]
    + [(5, k, k - 1 if k else None, "user" if k % 2 else "assistant", NASTY[k % len(NASTY)], float(k)) for k in range(37)]
    + [(5, 100 + k, 3 * k, "assistant", f"branch {k}", 40.0) for k in range(8)]
)


@pytest.mark.parametrize("branches", [None, 1, 3])
def test_trees(spark, branches):
    df = spark.createDataFrame([(*r, "x", 1) for r in TREES], SCHEMA + ", leaf string, start int").repartition(4)
    got = {}
    out = cf.format_trees(df, branches)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["tree"], []).append((r["leaf"], r["formatted"], [tuple(s) for s in r["loss"]]))
    want = {t: [(i, *plain_format(turns)) for i, turns in p] for t, p in plain_paths(TREES, branches).items()}
    assert got == want


def test_round_trip(spark):
    df = spark.createDataFrame(TREES, SCHEMA)
    back = {}
    for r in sorted(cf.read_back(cf.format_trees(df)).collect(), key=lambda r: r["pos"]):
        back.setdefault((r["tree"], r["leaf"]), []).append((r["role"], r["text"], r["masked"]))
    for tree, found in plain_paths(TREES).items():
        for leaf, turns in found:
            assert back[tree, leaf] == [(a or "", b or "", (b or "") if a == "assistant" else None) for a, b in turns]


def test_deep_chain(spark):
    """Hundreds of turns take the logarithm of their number of rounds."""
    rows = [(9, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"t{k}", 0.0) for k in range(300)]
    (r,) = cf.format_trees(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r["formatted"], [tuple(s) for s in r["loss"]]) == plain_format([(x[3], x[4]) for x in rows])


def test_query_against_sql(spark):
    got = {tuple(r) for r in cf.op13_chat_format(spark, "/root/testdata/sf0.001").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    duck = duckdb.connect()
    duck.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    assert got == set(duck.execute(cf.ORACLE_SQL).fetchall())
    probe = next(r for r in got if r[0] == -1)
    assert probe[3:5] == (len(cf.PROBE), hashlib.sha256(cf.PROBE.encode()).hexdigest())


def test_chains_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, "system", "first"), (None, 0, "assistant", "lost"), (2, 0, "assistant", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cf.digests(cf.format_trees(cf.as_chains(df))).collect()}
    said = "system\nfirst\nuser\n\n\nx\nassistant\na\nassistant\nb\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == 2
    assert got[None]["loss_chars"] == 4 and got[2]["loss_chars"] == 300_000


def test_empty(spark):
    assert cf.format_trees(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cf.read_back(cf.format_trees(spark.createDataFrame([], SCHEMA))).collect() == []
