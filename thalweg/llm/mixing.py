"""Operator 2: mixing sources to target weights, in DataFrame operations alone.

A naive Bayes classifier, fitted on MAX_LABELS labelled rows at most in the order
of a hash, gives each document a posterior for each domain. Its features are
binned: the shape of the text, and how its distinct words lean to each domain.
The words' leanings are counted on one half of those rows and the bins on the
other half, so that words which occur once don't speak for themselves. The rows
are so few that they are broadcast, and no text is shuffled.

Projected-gradient least squares then finds document rates, none negative, whose
expected domain token totals match targets: every round is one sum over the
documents and one step along the residual, scaled by the inverse of the domains'
Gram matrix, and rates below zero are set to zero. A rate above one repeats a
document. If TOLERANCE is not met after ROUNDS, the best rates count and a
warning says by how much they miss.

Defined results: a null or empty text has no tokens and the prior's posterior;
without labels of at least two target domains every posterior is equal; labels
of other domains are left out; conflicting labels of one doc_id count each;
repeated rows are documents each, with equal posteriors and rates; rows without
doc_id are mixed as all others; a text of any length is one row of words;
extra columns, whatever their names, are kept by mix() and ignored otherwise;
targets that cannot be reached are approached as far as rates allow that are
not negative; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of the expected tokens that the domains low and high (quality 0 and 1) are to have.
TARGET = {"low": 0.03, "high": 0.97}
#: Labelled rows that the classifier is fitted on, at most.
MAX_LABELS = 20_000
BINS = 16
#: Classes of words, by a hash.
WORDS = 4096
ROUNDS = 30
TOLERANCE = 1e-4


def _table(numbers: list[float]) -> Column:
    """A constant array, in one literal."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _once(rows: DataFrame, *names: str) -> DataFrame:
    """rows with those columns worked out once: what uses them, filters too, is not merged with their expressions."""
    kept = [c for c in rows.columns if c not in names]
    return rows.select(*kept, F.explode(F.array(F.struct(*names))).alias("_x")).select(*kept, "_x.*")


def features(docs: DataFrame) -> DataFrame:
    """docs with _tokens (words), _kinds (the classes of its distinct words) and _shape (numbers about its form, in bins)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.withColumn("_kinds", F.transform(F.array_distinct("_words"), lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int")))
    n_tokens = F.size("_words").cast("bigint")
    n = F.greatest(n_tokens, F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.regexp_count(text, F.lit(r"[%&*#$|@^~=<>_\[\]{}\\/+]"))
    # distinct words against what their number lets expect
    variety = F.log(F.greatest(F.size("_kinds"), F.lit(1)).cast("double")) / F.greatest(F.log(n + 1), F.lit(0.1))
    scaled = F.array(F.lit(40.0) * letters / chars, F.lit(BINS) * F.greatest(F.lit(0.0), (variety - 0.5) * 2), chars / n, F.log2(n + 1))
    return docs.withColumn("_tokens", n_tokens).withColumn("_shape", scaled).drop("_words")


def _mean_leaning(table: Column) -> Column:
    return F.aggregate("_kinds", F.lit(0.0), lambda total, k: total + F.element_at(table, k + 1)) / F.greatest(F.size("_kinds"), F.lit(1))


def binned(rows: DataFrame, leanings: list[list[float]]) -> DataFrame:
    """Rows of features() with _bins, the place on each feature; leanings are of each class of words, for each domain but the first."""
    lean = F.array(*[F.lit(BINS / 2) + _mean_leaning(_table(w)) * (BINS / 4) for w in leanings]).cast("array<double>")
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x))).cast("int")
    return _once(rows.withColumn("_bins", F.transform(F.concat("_shape", lean), place)).drop("_shape", "_kinds"), "_tokens", "_bins")


def word_leanings(rows: DataFrame, domains: list[str]) -> list[list[float]]:
    """Of rows (_kinds, domain), the log-odds of each class of words, for each domain but the first against the others."""
    found = rows.select("domain", F.explode("_kinds").alias("kind")).groupBy("domain", "kind").agg(F.count("*").alias("n")).collect()  # domains x WORDS rows at most
    n = {(r["domain"], r["kind"]): r["n"] for r in found}
    total = {d: sum(n.get((d, k), 0) for k in range(WORDS)) for d in domains}
    out = []
    for d in domains[1:]:
        others = [x for x in domains if x != d]
        rest = sum(total[x] for x in others)
        out.append([round(math.log((n.get((d, k), 0) + 1) / (total[d] + WORDS)) - math.log((sum(n.get((x, k), 0) for x in others) + 1) / (rest + WORDS)), 6) for k in range(WORDS)])
    return out


def log_rates(binned: DataFrame, domains: list[str]) -> list[tuple[float, list[list[float]]]]:
    """Of rows (_bins, domain): for each domain its prior and each feature's log-probability of each bin."""
    counts = binned.select("domain", F.posexplode("_bins").alias("feature", "bin")).groupBy("domain", "feature", "bin").agg(F.count("*").alias("n")).collect()  # domains x features x BINS rows at most
    total = {d: sum(r["n"] for r in counts if r["domain"] == d and r["feature"] == 0) for d in domains}
    features = 1 + max((r["feature"] for r in counts), default=0)
    n = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in counts}
    every = max(sum(total.values()), 1)
    return [(math.log((total[d] + 0.5) / every), [[math.log((n.get((d, f, b), 0) + 0.5) / (total[d] + 0.5 * BINS)) for b in range(BINS)] for f in range(features)]) for d in domains]


def posteriors(rates: list[tuple[float, list[list[float]]]]) -> list[Column]:
    """Of each domain, from _bins."""
    scores = []
    for prior, features in rates:
        z = F.lit(prior)
        for f, w in enumerate(features):
            z = z + F.element_at(_table(w), F.col("_bins")[f] + 1)
        scores.append(z)
    most = scores[0] if len(scores) == 1 else F.greatest(*scores)
    shares = [F.exp(F.greatest(z - most, F.lit(-30.0))) for z in scores]
    total = shares[0]
    for s in shares[1:]:
        total = total + s
    return [s / total for s in shares]


class Classifier:
    """Learned from docs (doc_id, text) with labels (doc_id, domain); soft() adds _tokens and a posterior _p<i> for each domain."""

    def __init__(self, docs: DataFrame, labels: DataFrame, domains: list[str]) -> None:
        self.domains, self.leanings, self.rates = domains, [], []
        known = labels.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "domain")
        known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(MAX_LABELS))
        rows = features(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(known, "doc_id")).drop("text").checkpoint()
        if rows.select("domain").distinct().count() < 2:
            return
        half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
        first, second = rows.filter(half == 0), rows.filter(half == 1)
        if min(x.select("domain").distinct().count() for x in (first, second)) < 2:
            second = rows  # too few labels for halves: the shape alone
        else:
            self.leanings = word_leanings(first, domains)
        self.rates = log_rates(binned(second, self.leanings), domains)

    def soft(self, docs: DataFrame) -> DataFrame:
        rows = binned(features(docs), self.leanings)
        shares = posteriors(self.rates) if self.rates else [F.lit(1.0 / len(self.domains))] * len(self.domains)
        return _once(rows.withColumns({f"_p{i}": p for i, p in enumerate(shares)}).drop("_bins"), *[f"_p{i}" for i in range(len(shares))])


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b by elimination; a little ridge keeps it solvable."""
    n = len(b)
    ridge = 1e-9 + 1e-6 * sum(a[i][i] for i in range(n))
    m = [[*(a[i][j] + ridge * (i == j) for j in range(n)), b[i]] for i in range(n)]
    for i in range(n):
        lead = max(range(i, n), key=lambda k: abs(m[k][i]))
        m[i], m[lead] = m[lead], m[i]
        for k in range(n):
            if k != i:
                times = m[k][i] / m[i][i]
                m[k] = [x - times * y for x, y in zip(m[k], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def rates(docs: DataFrame, shares: list[float]) -> Column:
    """The rate of each row of docs (_tokens, _p0, _p1, ...), as an expression of its posteriors.

    The total is the largest for which no domain needs more tokens than it has.
    """
    k = len(shares)
    p = [F.col(f"_p{i}") for i in range(k)]
    tokens = F.col("_tokens").cast("double")
    s = docs.agg(*[F.sum(tokens * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(tokens * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    have = [s[f"s{i}"] or 0.0 for i in range(k)]
    if not any(have):
        return F.lit(1.0)
    total = min(h / w for h, w in zip(have, shares, strict=True) if w > 0)
    goal = [total * w for w in shares]
    gram = [[s[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
    rate = F.lit(1.0)
    best, best_miss = rate, math.inf
    for _ in range(ROUNDS):
        miss = max(abs(h - g) for h, g in zip(have, goal, strict=True)) / max(total, 1e-9)
        if miss < best_miss:
            best, best_miss = rate, miss
        if miss < TOLERANCE:
            break
        step = F.lit(0.0)
        for x, column in zip(_solved(gram, [h - g for h, g in zip(have, goal, strict=True)]), p, strict=True):
            step = step + column * x
        rate = F.greatest(F.lit(0.0), rate - step)
        now = docs.agg(*[F.sum(tokens * p[i] * rate).alias(f"s{i}") for i in range(k)]).first()
        have = [now[f"s{i}"] for i in range(k)]
    if best_miss >= TOLERANCE:
        warnings.warn(f"rates miss their targets by {best_miss:.4f} of all tokens", stacklevel=2)
    return best


def by_quality(labels: DataFrame) -> DataFrame:
    """Labels (doc_id, quality) as labels of the domains of TARGET."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("domain"))


def weigh(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate of docs; labels are (doc_id, domain)."""
    target = target or TARGET
    soft = Classifier(docs, labels, list(target)).soft(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text").checkpoint()
    return soft.withColumn("rate", rates(soft, list(target.values()))).select("doc_id", F.col("_tokens").alias("n_tokens"), *[F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(target)], "rate")


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as its rate says: its whole part, and once more with the probability of the rest, by a hash of doc_id and text.

    Posteriors are worked out twice, for the totals and for the rows: that costs less than to write all texts between.
    """
    target = target or TARGET
    model = Classifier(docs, labels, list(target))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_doc_id"), "text")
    soft = model.soft(packed.drop("_row")).select("_tokens", *[f"_p{i}" for i in range(len(target))]).checkpoint()
    rate = rates(soft, list(target.values()))
    chance = F.pmod(F.xxhash64("_doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")
    out = _once(model.soft(packed).withColumn("_times", times.cast("int")), "_times").filter("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"), by_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")))
