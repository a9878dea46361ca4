"""Operator 7: secret scans with a random forest against false positives.

Patterns find candidates in whole texts (a linear-time expression picks the
texts that have any); a random forest keeps those that look like secrets. Its
features are the candidate's length, entropy, character transitions, dictionary
coverage, its path and the words around it. The dictionary is the corpus's own:
words that SHARE of all documents have, counted over all of them; there are at
most 1 / SHARE times the mean number of distinct words of a document. The forest
is trained on labelled findings; labelled_findings() makes the ones that are used
here, with words of the dictionary.

A candidate is the whole secret, however long: a private key runs to its END
line, or without one to the end of its base64 block. A well-known form inside an
assigned or opaque value is a candidate of its own; what is left of the value on
either side stays one where it is long enough. A private key is judged by its
BEGIN line. Both engines take the same spaces and ASCII word boundaries.

Defined results: a null or empty text has no findings; a null path is an empty
one; repeated rows have their findings each, and alike; where two rules match at
one place the first of PATTERNS counts; a text of any length is searched in one
piece, in some ten times its size of a task's memory; texts without findings give
no rows in scan() and come back unchanged from redact(); extra columns are kept
by redact() and ignored by scan(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space as characters, since the two engines differ in what \s is.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Forms of well-known secrets. The last group, or the whole, is the candidate.
PATTERNS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned": rf"\b(?:[Pp]ass(?:word|wd|phrase)?|PASSWORD|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY|[Aa]ccess[_-]?[Kk]ey|[Aa]uth)[\"']?[{SPACE}]{{0,3}}[:=][{SPACE}]{{0,3}}[\"']?(?P<assigned>[^{SPACE}\"',;]{{6,}})",
    "opaque": r"\b(?P<opaque>[A-Za-z0-9+/_-]{24,}={0,2})",
}
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "key")
HARMLESS = ("sha256", "sha1", "md5", "commit", "checksum", "digest", "uuid", "id", "revision", "hash", "integrity", "build")
PLACEHOLDERS = ("example", "changeme", "change", "your", "password", "secret", "token", "sample", "dummy", "placeholder", "test", "foo", "bar", "xxxx", "1234", "abcd", "none", "null", "true", "false", "insert", "here", "redacted", "user", "admin", "config", "value", "string", "name", "default")
PATH_MARKS = ("test", "example", "sample", "doc", "mock", "fixture")

#: Share of the documents, and number of them, that a word of the dictionary is in.
SHARE, LEAST_DOCS = 1e-3, 5

LEAST = {"assigned": 6, "opaque": 24}  # as in their patterns

_KNOWN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k not in LEAST), re.ASCII)
_GENERAL = re.compile("|".join(PATTERNS[k] for k in LEAST), re.ASCII)
_PRESENT = "|".join(v.replace("(?P<assigned>", "(?:").replace("(?P<opaque>", "(?:") for v in PATTERNS.values())
_KEY_LINE = re.compile(PATTERNS["private_key"])
_KEY_MARK = re.compile(r"-----(?:BEGIN|(?P<end>END)) [A-Z ]*PRIVATE KEY-----")
# a block: header lines, long lines, and a shorter last line of its own; line ends may be written as \n
_BREAK = rf"(?:[{SPACE}]|\\[nr])"
_KEY_BLOCK = re.compile(rf"(?:{_BREAK}+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{32,}}+={{0,2}})++(?:{_BREAK}+[A-Za-z0-9+/]{{1,31}}+={{0,2}}(?=[ \t\"']*(?:[\r\n]|\\[nr]|$)))?|{_BREAK}+[A-Za-z0-9+/]{{16,}}={{0,2}}")
_WORDS = re.compile(r"[A-Za-z_]+")
VOWELS = set("aeiouAEIOU")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def corpus_words(docs: DataFrame, share: float = SHARE) -> tuple[str, ...]:
    """The words of four letters and more that at least `share` of the texts have, over all of docs."""
    n = docs.filter("text is not null").count()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(LEAST_DOCS, share * n))
    return tuple(sorted(r["word"] for r in often.select("word").collect()))


class Dictionary:
    """Words to be found anywhere in a value."""

    def __init__(self, words: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(w, len(w))
        if words:
            self.automaton.make_automaton()

    def covered(self, lowered: str) -> int:
        """Letters of the text that are in some word."""
        until = covered = 0
        spans = sorted((last + 1 - n, last + 1) for last, n in self.automaton.iter(lowered)) if len(self.automaton) else []
        for start, end in spans:
            covered += max(0, end - max(start, until))
            until = max(until, end)
        return covered


def features(value: str, rule: str, path: str, before: str, after: str, dictionary: Dictionary) -> list[float]:
    n = max(len(value), 1)
    count = Counter(value)
    kinds = [_kind(c) for c in value]
    lowered = value.lower()
    covered = [False] * len(value)
    for w in (*PLACEHOLDERS, *(x.lower() for x in _WORDS.findall(before + " " + after) if len(x) > 3)):
        at = lowered.find(w)
        while at >= 0:
            covered[at : at + len(w)] = [True] * len(w)
            at = lowered.find(w, at + 1)
    near = [w.lower() for w in _WORDS.findall(before)[-3:]]
    letters = [c for c in value if c.isalpha()]
    pairs = list(zip(value, value[1:], strict=False))
    return [
        len(value),
        -sum(v / n * math.log2(v / n) for v in count.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(a.isalpha() and b.isalpha() and (a in VOWELS) != (b in VOWELS) for a, b in pairs) / n,
        sum(a == b for a, b in pairs) / n,
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        sum(c in VOWELS for c in letters) / max(len(letters), 1),
        sum(covered) / n,
        dictionary.covered(lowered) / n,
        max(Counter(re.split(r"[-_/+.]", value)).values()),
        float(value.count("-") + value.count("/") + value.count("_")),
        float(any(m in path.lower() for m in PATH_MARKS)),
        float(any(k in w for w in near for k in KEYWORDS)),
        float(any(w.startswith(h) for w in near for h in HARMLESS)),
        float(list(PATTERNS).index(rule)),
    ]


def labelled_findings(n: int = 3000, seed: int = 7, words: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, str, int]]:
    """(value, rule, path, before, after, label): secrets and what is mistaken for them, half and half; of the dictionary's words where there are many."""
    r = random.Random(seed)
    pick = lambda alphabet, size: "".join(r.choice(alphabet) for _ in range(size))
    syllable = lambda: r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t", "nd"])
    word = lambda: r.choice(words) if len(words) >= 100 and r.random() < 0.7 else "".join(syllable() for _ in range(r.randint(1, 4)))
    said = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    out = []
    for i in range(n):
        key = r.choice(KEYWORDS[:8])
        path = r.choice(["src0", "web/app.py", "conf/settings.yml", "notes/log.txt", "src12"])
        before, after = said() + " ", " " + said()
        if i % 2:
            rule, value = r.choice(
                [
                    ("aws_key", r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16)),
                    ("github_token", "ghp_" + pick(alnum, 36)),
                    ("slack_token", "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)),
                    ("stripe_key", "sk_live_" + pick(alnum, 24)),
                    ("google_key", "AIza" + pick(alnum + "_-", 35)),
                    ("jwt", "eyJ" + pick(alnum, 30) + ".eyJ" + pick(alnum, 60) + "." + pick(alnum + "_-", 43)),
                    ("private_key", r.choice(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"])),
                    *[("assigned", r.choice([pick(hexa, r.randint(10, 64)), pick(alnum, r.randint(8, 40)), pick(alnum + "!@#%^*", r.randint(8, 24)), pick(hexa, 18), pick(hexa, 40)]))] * 5,
                    ("opaque", pick(alnum + "+/", r.randint(32, 88))),
                ]
            )
            if rule == "assigned":
                before += f"{key}{r.choice(['=', ': ', ' = '])}{r.choice(['', chr(34)])}"
            elif rule == "opaque":
                before += r.choice(["secret ", "api_key ", "Authorization Bearer token "])
        else:
            rule, value = r.choice(
                [
                    ("assigned", r.choice(["changeme", "your_password_here", "example", "<your-token>", "${DB_PASSWORD}", "xxxxxxxxxxxx", "********", "12345678", "os.environ", "getpass()", "None", "placeholder", "test1234", "secretsecret"])),
                    ("assigned", word() + word()),
                    ("assigned", word() + "_" + word() + r.choice(["()", ".get", ""])),
                    ("aws_key", "AKIA" + r.choice(["EXAMPLEEXAMPLE12", "XXXXXXXXXXXXXXXX", "IOSFODNN7EXAMPLE"])),
                    ("opaque", "".join(word() for _ in range(12))[: r.randint(24, 60)].ljust(24, "e")),
                    ("opaque", "-".join(word() for _ in range(7)).ljust(24, "a")),
                    ("opaque", "/".join(word() for _ in range(7)).ljust(24, "a")),
                    ("opaque", "".join(word() for _ in range(24)).capitalize()[: r.randint(24, 40)]),
                    ("opaque", "-" * r.randint(24, 60)),
                    ("opaque", "_" * r.randint(24, 60)),
                    ("opaque", str(uuid.UUID(int=r.getrandbits(128)))),
                    ("opaque", pick(hexa, r.choice([32, 40, 64]))),
                    ("opaque", pick(string.digits, r.randint(24, 30))),
                    ("github_token", "ghp_" + "x" * 36),
                    ("stripe_key", "sk_test_" + "your" * 6),
                    ("slack_token", "xoxb-your-token-here"),
                    ("jwt", "eyJexampleexample.exampleexample.signature"),
                ]
            )
            if rule == "assigned":
                before += f"{key}{r.choice(['=', ': ', ' = '])}{r.choice(['', chr(34)])}"
            elif rule == "opaque" and r.random() < 0.6:
                before += r.choice(["sha256 ", "commit ", "uuid: ", "checksum ", "id ", "md5 "])
            path = r.choice([path, "tests/test_auth.py", "docs/example.md"])
        out.append((value, rule, path, before, after, i % 2))
    return out


class Forest:
    """Binary decision trees on bootstrap samples and random feature subsets, in numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            tree: list = []
            self._grow(tree, x[rows], y[rows], depth, rng)
            self.trees.append([np.array(c) for c in zip(*tree, strict=True)])

    def _grow(self, tree: list, x, y, depth: int, rng) -> int:
        at, share = len(tree), float(y.mean())
        tree.append((-1, 0.0, 0, 0, share))
        if depth == 0 or len(y) < 4 or share in (0.0, 1.0):
            return at
        best = (share * (1 - share) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
                left = x[:, f] <= cut
                k = int(left.sum())
                if 0 < k < len(y):
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) / len(y)
                    if impurity < best[0]:
                        best = (impurity, f, cut)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            low = self._grow(tree, x[left], y[left], depth - 1, rng)
            high = self._grow(tree, x[~left], y[~left], depth - 1, rng)
            tree[at] = (int(best[1]), float(best[2]), low, high, share)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, low, high, share in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(go, low[node], high[node]), node)
            total += share[node]
        return total / len(self.trees)


class Model:
    """A dictionary and the forest that was trained with it."""

    def __init__(self, words: tuple[str, ...] = (), findings: list[tuple[str, str, str, str, str, int]] | None = None) -> None:
        self.words = words
        findings = labelled_findings(words=words) if findings is None else findings
        self.forest = Forest(self.table([f[:5] for f in findings]), np.array([f[5] for f in findings], float))

    def table(self, findings: list[tuple[str, str, str, str, str]]) -> np.ndarray:
        dictionary = Dictionary(self.words)
        return np.array([features(*f, dictionary) for f in findings])

    def predict(self, findings: list[tuple[str, str, str, str, str]]) -> np.ndarray:
        return self.forest.predict(self.table(findings))


@lru_cache(maxsize=4)
def model_of(words: tuple[str, ...]) -> Model:
    return Model(words)


def fit(docs: DataFrame) -> Model:
    """The model with the dictionary of docs."""
    return model_of(corpus_words(docs))


def _key_end(text: str, at: int) -> int:
    """Where the private key ends whose BEGIN line ends at `at`."""
    mark = _KEY_MARK.search(text, at)
    if mark and mark["end"]:
        return mark.end()
    block = _KEY_BLOCK.match(text, at, mark.start() if mark else len(text))
    return block.end() if block else at


def _known(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    while m := _KNOWN.search(text, at):
        at = _key_end(text, m.end()) if m.lastgroup == "private_key" else m.end()
        yield m.start(), at, m.lastgroup


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each candidate, in code points, in order and apart."""
    known = list(_known(text))
    ends = [b for _, b, _ in known]
    out = list(known)
    for m in _GENERAL.finditer(text):
        rule = m.lastgroup
        start, end = m.span(rule)
        i = bisect_right(ends, start)
        while i < len(known) and known[i][0] < end:
            a, b, _ = known[i]
            if a - start >= LEAST[rule]:
                out.append((start, a, rule))
            start, i = b, i + 1
        if end - start >= LEAST[rule]:
            out.append((start, end, rule))
    return sorted(out)


def find(texts: pa.Array, paths: list, model: Model) -> Iterator[tuple[int, list[tuple[int, int, str, float]]]]:
    """(row, its findings with their probability) for the rows that have any."""
    rows, places, x = [], [], []
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _PRESENT), False).to_numpy(zero_copy_only=False)).tolist():
        text = texts[i].as_py()
        for start, end, rule in candidates(text):
            rows.append(i)
            places.append((start, end, rule))
            if rule == "private_key":
                end = _KEY_LINE.match(text, start).end()
            x.append((text[start:end], rule, paths[i] or "", text[max(0, start - 40) : start], text[end : end + 40]))
    if rows:
        by_row: dict[int, list] = {}
        for i, place, p in zip(rows, places, model.predict(x).tolist(), strict=True):
            by_row.setdefault(i, []).append((*place, round(p, 6)))
        yield from by_row.items()


FINDINGS = "doc_id bigint, start int, end int, rule string, probability double, is_secret boolean, value_sha256 string"


def scan(docs: DataFrame, path: str = "source", model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate of docs (doc_id, text, path): where it is, the forest's probability and its verdict; by default with the dictionary of docs."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for i, found in find(texts, batch.column(2).to_pylist(), model):
                text = texts[i].as_py()
                out += [(ids[i], a, b, rule, p, p >= threshold, hashlib.sha256(text[a:b].encode()).hexdigest()) for a, b, rule, p in found]
            names = [x.split()[0] for x in FINDINGS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string()), strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(path).cast("string").alias("path")).mapInArrow(run, FINDINGS)


def redact(docs: DataFrame, path: str = "source", model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with each confirmed secret replaced by its rule's name in brackets; by default with the dictionary of docs."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            changed = {}
            for i, found in find(texts, batch.column(path).to_pylist(), model):
                text, done, parts = texts[i].as_py(), 0, []
                for a, b, rule, p in found:
                    if p >= threshold:
                        parts += [text[done:a], f"[{rule}]"]
                        done = b
                changed[i] = "".join([*parts, text[done:]])
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([texts if n == "text" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
