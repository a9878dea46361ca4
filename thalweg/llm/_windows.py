"""Repeated windows of a fixed number of tokens (bytes or words) over a whole corpus.

Two equal windows have the same smallest k-gram at the same place. So the
windows of a document fall into runs that share such an anchor, and only runs
whose anchor k-gram is equal need to be compared. The passes:

1. every document becomes runs (k-gram, fingerprint of the run's whole text,
   document, place): about two per window length, not one per token;
2. runs are dealt by k-gram; equal texts settle all windows of a run at once;
   runs that share a k-gram but differ somewhere are left open;
3. the text of open runs, and of no others, is dealt by k-gram and compared
   window by window. Where a k-gram has more than HOT texts (a line that
   very many documents continue in their own ways), its windows are dealt one
   by one by their fingerprints instead, and no task gets them all. K-grams so
   frequent that their runs would not fit beside others in a bucket are found in
   a sample first; their runs are dealt by their whole texts in the second pass.
   Which ones those are changes the way of their runs, not the result.

Runs with equal text inside one task's piece of input are settled there, so a
text that fills a third of the corpus reaches its bucket once per piece.
Fingerprints have 64 bits and are always compared together with the k-gram's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from . import _text

RUNS = "bucket int, gram array<bigint>, body array<bigint>, doc array<bigint>, start array<int>, n array<int>, copies array<int>"
#: state: how far a run got
MARKS = "doc_id bigint, start int, n int, gram bigint, state int"
SETTLED, OPEN, HOT_OPEN = 0, 1, 2
#: Texts of one k-gram that one task compares.
HOT = 256
#: texts: of open runs; null where a row holds fingerprints alone
TEXTS = RUNS + ", texts array<binary>"
SPANS = "doc_id bigint, start int, n int"
#: Runs that a task keeps before it settles and sends them.
FLUSH = 1 << 19
#: Bytes of text for each bucket; documents that frequent k-grams are looked for in, about; least texts of one, and its share of them.
BUCKET_BYTES, SAMPLED, FREQUENT, FREQUENT_SHARE = 1 << 25, 100_000, 8, 1 / 256

COLUMNS = {"gram": np.int64, "body": np.int64, "doc": np.int64, "start": np.int32, "n": np.int32, "copies": np.int32}

#: The columns above, an item for each run.
Runs = dict[str, np.ndarray]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def runs_of(codes: np.ndarray, bounds: np.ndarray, window: int, k: int, most: int = 1 << 20) -> Runs:
    """The runs of each row of `codes`, of a single long row those of stretches of `most` windows: row, start (in the row), n windows, gram, body."""
    if len(bounds) != 2 or len(codes) < most + window:
        return _runs_of(codes, bounds, window, k)
    out = []
    for at in range(0, len(codes) - window + 1, most):
        part = codes[at : at + most + window - 1]
        out.append(_runs_of(part, np.array([0, len(part)]), window, k))
        out[-1]["start"] += at
    return concat(out)


def _runs_of(codes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> Runs:
    empty = {"row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "gram": np.zeros(0, np.uint64), "body": np.zeros(0, np.uint64)}
    n = len(codes)
    if n < window:
        return empty
    prefix = _text.prefix_hash(codes)
    at = np.arange(n - k + 1)
    grams = _text.span_hash(prefix, at, at + k)
    # a fixed width, so that every piece of input ranks two grams alike
    mask = np.uint64((1 << 32) - 1)
    least = _sliding_min((grams & ~mask) | at.astype(np.uint64), window - k + 1)
    row = _text.row_of(bounds)
    p = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(p):
        return empty
    anchor = (least[p] & mask).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first, last = p[np.r_[0, cut]], p[np.r_[cut - 1, len(p) - 1]]
    r = row[first]
    return {"row": r, "start": first - bounds[r], "n": last - first + 1, "gram": grams[anchor[np.r_[0, cut]]], "body": _text.span_hash(prefix, first, last + window)}


def sort_runs(runs: Runs) -> Runs:
    order = np.lexsort((runs["start"], runs["doc"], runs["body"], runs["gram"]))
    return {k: v[order] for k, v in runs.items()}


def settle(runs: Runs) -> tuple[Runs, Runs]:
    """Of sorted runs, the first of each text, with the number of its copies, and the others. A run met twice counts once."""
    if not len(runs["gram"]):
        return runs, runs
    same_text = np.r_[False, (np.diff(runs["gram"]) == 0) & (np.diff(runs["body"]) == 0)]
    again = same_text & np.r_[False, (np.diff(runs["doc"]) == 0) & (np.diff(runs["start"]) == 0)]
    heads = np.flatnonzero(~same_text)
    copies = np.add.reduceat(np.where(again, 0, runs["copies"]), heads)
    kept = {k: v[heads] for k, v in runs.items()}
    return kept | {"copies": np.minimum(copies, 1 << 30).astype(np.int32)}, {k: v[same_text & ~again] for k, v in runs.items()}


def concat(parts: list[Runs]) -> Runs:
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def _rows(bucket: np.ndarray, every: Runs, texts: list[bytes] | None = None) -> pa.RecordBatch:
    """One row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else np.zeros(0, int)
    bounds = np.r_[heads, len(bucket)]
    cols = [pa.array(bucket[heads], pa.int32())] + [_text.lists(bounds, every[k][order].astype(t)) for k, t in COLUMNS.items()]
    if texts is None:
        last = pa.nulls(len(heads), pa.list_(pa.binary()))
    else:
        last = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array([texts[i] for i in order.tolist()], pa.binary()))
    return pa.RecordBatch.from_arrays([*cols, last], ["bucket", *COLUMNS, "texts"])


def _joined(runs: Runs) -> Runs:
    """Runs that follow each other in a document as one; of their other columns the first's hold."""
    if not len(runs["doc"]):
        return runs
    order = np.lexsort((runs["start"], runs["doc"]))
    runs = {k: v[order] for k, v in runs.items()}
    end = runs["start"].astype(np.int64) + runs["n"]
    heads = np.flatnonzero(np.r_[True, (np.diff(runs["doc"]) != 0) | (runs["start"][1:] > end[:-1])])
    last = np.maximum.reduceat(end, heads)
    return {k: v[heads] for k, v in runs.items()} | {"n": (last - runs["start"][heads]).astype(np.int32)}


def bucket_ids(spark: SparkSession, n: int) -> np.ndarray:
    """n bucket ids that hash partitioning puts into n different partitions, so that no task gets several buckets and others none."""
    ids = spark.range(64 * n).select(F.col("id").cast("int").alias("id"))
    rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).toPandas()  # n rows at most
    out = np.arange(64 * n, 65 * n, dtype=np.int32)
    out[rows["part"]] = rows["id"]
    return out


def _bucket_of(prints: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ids[(prints.astype(np.uint64) % np.uint64(len(ids))).astype(np.int64)]


def _among(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which of grams (signed or not) are in a sorted table of signed ones."""
    return np.isin(grams.astype(np.int64), frequent) if len(frequent) else np.zeros(len(grams), bool)


NONE = np.zeros(0, np.int64)


def _send(runs: Runs, ids: np.ndarray, both: bool, frequent: np.ndarray = NONE) -> pa.RecordBatch:
    """Runs of frequent grams go by their texts. What is settled here (all but the first of each text; with `both` the first as well) goes along under a bucket of its document, with copies 0."""
    kept, others = settle(sort_runs(runs))
    done = _joined(concat([others] if not both else [others, {k: v[kept["copies"] > 1] for k, v in kept.items()}]))
    by_text = _among(kept["gram"], frequent)
    bucket = np.concatenate([_bucket_of(np.where(by_text, _text.mix(kept["body"].astype(np.uint64)), kept["gram"].astype(np.uint64)), ids), _bucket_of(_text.mix(done["doc"].astype(np.uint64)), ids)])
    done["copies"] = np.zeros(len(done["doc"]), np.int32)
    return _rows(bucket, concat([kept, done]))


Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _text.BYTE_CODES[data], offsets


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = _text.words(data, offsets)
    return _text.word_hashes(data, starts, ends), bounds


def _runs(docs: DataFrame, tokens: Tokens, window: int, k: int, bucket_ids: np.ndarray, both: bool, frequent: np.ndarray = NONE) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in _text.pieces(batch.column(1)):
                runs = runs_of(*tokens(data, offsets), window, k)
                if len(runs["row"]):
                    runs["doc"], runs["copies"] = ids[first:end][runs.pop("row")], np.ones(len(runs["n"]), np.int32)
                    held.append(runs)
                    count += len(runs["n"])
                if count > FLUSH:
                    yield _send(concat(held), bucket_ids, both, frequent).drop_columns("texts")
                    held, count = [], 0
        if held:
            yield _send(concat(held), bucket_ids, both, frequent).drop_columns("texts")

    return docs.mapInArrow(deal, RUNS)


def batches_of(table: pa.Table) -> Iterator[Runs]:
    """What each piece of input sent to a bucket; what was settled there comes as {"done": runs}."""
    for batch in table.to_batches():
        arrays = {k: batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in COLUMNS}
        live = arrays["copies"] > 0
        yield {k: v[live] for k, v in arrays.items()} | {"done": {k: v[~live] for k, v in arrays.items()}}


def marks(parts: list[tuple[Runs, np.ndarray | int]]) -> pa.Table:
    """Rows of MARKS from runs and their states."""
    return pa.concat_tables(
        [pa.table({"doc_id": pa.array(r["doc"], pa.int64()), "start": pa.array(r["start"], pa.int32()), "n": pa.array(r["n"], pa.int32()), "gram": pa.array(r["gram"], pa.int64()), "state": pa.array(np.broadcast_to(s, len(r["doc"])), pa.int32())}) for r, s in parts]
    )


def open_runs(runs: Runs, frequent: np.ndarray) -> tuple[Runs, np.ndarray]:
    """Of sorted runs with distinct texts, those whose gram another text has too, here or (of frequent grams) in another bucket, and their states."""
    gram = runs["gram"]
    heads = np.flatnonzero(np.r_[True, np.diff(gram) != 0]) if len(gram) else np.zeros(0, int)
    texts = np.diff(np.r_[heads, len(gram)])
    texts = np.repeat(texts, texts)
    often = _among(gram, frequent)
    near = (texts > 1) | often
    return {k: v[near] for k, v in runs.items()}, np.where((texts[near] > HOT) | often[near], HOT_OPEN, OPEN)


def keyed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs (doc_id, text) that have a doc_id, their number and bytes; the docs as (key, text): the doc_id itself; or, where a doc_id has unlike texts, (key, text, doc_id) with the place of (doc_id, text) in the order of doc_ids and fingerprints."""
    known = docs.filter("doc_id is not null")
    print_ = F.xxhash64(F.coalesce("text", F.lit("")))
    sums = known.select("doc_id", print_.alias("print"), F.octet_length("text").alias("bytes")).groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    size = sums.agg(F.count_if(F.col("low") != F.col("high")).alias("several"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    n, n_bytes = size["n"] or 0, size["bytes"] or 0
    if not size["several"]:
        return known.select(F.col("doc_id").alias("key"), "text"), n, n_bytes
    told = known.withColumn("print", print_)
    places = told.select("doc_id", "print").distinct().repartitionByRange("doc_id", "print").sortWithinPartitions("doc_id", "print")
    # partitions are ranges in order, so these ids are in order too
    places = shared.written(places.withColumn("key", F.monotonically_increasing_id()), "places")
    return told.join(places, ["doc_id", "print"]).select("key", "text", "doc_id"), n, n_bytes


def frequent_grams(docs: DataFrame, n: int, tokens: Tokens, window: int, k: int, buckets: int) -> np.ndarray:
    """Anchors that a share of n documents (key, text) continue in their own ways, by a sample of SAMPLED documents (of one in 16, where that is less): no more than the sample has runs for each of FREQUENT texts, or 1 / FREQUENT_SHARE times a document's runs."""
    part = max(16, n // SAMPLED)
    sample = docs.select("key", "text").filter(F.pmod(F.xxhash64("key"), F.lit(part)) == 0)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _text.pieces(batch.column(1)):
                found = runs_of(*tokens(data, offsets), window, k)
                yield pa.RecordBatch.from_arrays([pa.array(found["gram"].astype(np.int64)), pa.array(found["body"].astype(np.int64))], ["gram", "body"])

    texts = shared.written(sample.mapInArrow(runs, "gram bigint, body bigint").distinct().groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT), "grams")
    total = texts.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, min(n / part * FREQUENT_SHARE, total / buckets))
    return np.sort(texts.filter(F.col("n") >= least).select("gram").toPandas()["gram"].to_numpy(np.int64))


def repeats(docs: DataFrame, tokens: Tokens, window: int, k: int, both: bool, bucket_fn: Callable, compare_fn: Callable, cut: Callable, finish: Callable, schema: str) -> DataFrame:
    """Run the passes over docs (doc_id, text).

    bucket_fn(table, frequent grams) -> MARKS of a bucket; cut(data, start, n) -> the bytes of
    an open run; compare_fn(table) -> SPANS; finish(text bytes, spans) -> row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known, n, n_bytes = keyed(docs)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    places = bucket_ids(spark, buckets)
    frequent = frequent_grams(known, n, tokens, window, k, buckets)
    found = _runs(known.select("key", "text"), tokens, window, k, places, both, frequent).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: bucket_fn(t, frequent), MARKS)

    dealt = known.repartition(buckets, "key")
    per_doc = lambda spans, *cols: spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct(*cols)).alias("spans"))

    def send_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            bounds, flat = _bounds(spans), spans.flatten()
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            every = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n", "gram", "state")}
            for first, end, data, offsets in _text.pieces(batch.column(1)):
                lo, hi = bounds[first], bounds[end]
                if hi == lo:
                    continue
                row, runs = _text.row_of(bounds[first : end + 1] - lo), {x: v[lo:hi] for x, v in every.items()}
                runs |= {"row": row, "doc": ids[row + first], "body": np.zeros(hi - lo, np.int64), "copies": np.ones(hi - lo, np.int32)}
                hot = runs.pop("state") == HOT_OPEN
                warm, hot = ({x: v[keep] for x, v in runs.items()} for keep in (~hot, hot))
                if len(warm["row"]):
                    yield _rows(_bucket_of(warm["gram"], places), warm, cut(data, offsets, warm["row"], warm["start"].astype(np.int64), warm["n"].astype(np.int64)))
                if len(hot["row"]):
                    yield _send(_single_windows(hot, *tokens(data, offsets), window), places, both)

    wanted = per_doc(found.filter(F.col("state") != SETTLED), "start", "n", "gram", "state")
    # a left join, as below: both read one exchange of the documents
    compared = dealt.join(wanted, "key", "left").mapInArrow(send_open, TEXTS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _compared(t, bucket_fn, compare_fn), SPANS)
    spans = per_doc(found.filter(F.col("state") == SETTLED).select("doc_id", "start", "n").unionByName(compared), "start", "n")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column("doc_id" if "doc_id" in batch.schema.names else "key").to_pylist(), batch.column("spans")
            bounds, flat = _bounds(spans), spans.flatten()
            start, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "n"))
            for first, end, data, offsets in _text.pieces(batch.column(1)):
                rows = [finish(ids[i], data[offsets[i - first] : offsets[i - first + 1]], start[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]]) for i in range(first, end)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = finish(None, np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int), schema_only=True)
    # rows without doc_id are in no match and go nowhere
    alone = docs.filter("doc_id is null").select(F.col("doc_id").alias("key"), "text", F.lit(None).cast("array<struct<start: int, n: int>>").alias("spans"))
    return dealt.join(spans, "key", "left").mapInArrow(last, schema).union(alone.mapInArrow(last, schema))


def _bounds(lists: pa.ListArray) -> np.ndarray:
    return np.r_[0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(), dtype=np.int64)]


def covered(n_tokens: int, window: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which tokens lie in a window of one of the spans."""
    step = np.zeros(n_tokens + 1, np.int64)
    ok = start + n - 1 + window <= n_tokens
    np.add.at(step, start[ok], 1)
    np.add.at(step, (start + n - 1 + window)[ok], -1)
    return np.cumsum(step)[:n_tokens] > 0


def _single_windows(runs: Runs, codes: np.ndarray, bounds: np.ndarray, window: int) -> Runs:
    """Each window of the runs as a run of its own, under its fingerprint."""
    n = runs["n"].astype(np.int64)
    each = np.repeat(np.arange(len(n)), n)
    start = runs["start"].astype(np.int64)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[runs["row"][each]] + start
    ok = at + window <= len(codes)
    each, start, at = each[ok], start[ok], at[ok]
    prints = _text.span_hash(_text.prefix_hash(codes), at, at + window)
    ones = np.ones(len(at), np.int32)
    return {"gram": prints, "body": _text.mix(prints), "doc": runs["doc"][each], "start": start, "n": ones, "copies": ones}


def _compared(table: pa.Table, bucket_fn: Callable, compare_fn: Callable) -> pa.Table:
    alone = pc.is_null(table["texts"])
    out, texts = [], table.filter(pc.invert(alone))
    if texts.num_rows:
        flat = {x: pa.concat_arrays([c.flatten() for c in texts[x].chunks]) for x in ("gram", "doc", "start", "n", "texts")}
        flat = pa.table({"gram": flat["gram"], "doc_id": flat["doc"], "start": flat["start"], "n": flat["n"], "body": flat["texts"]})
        out.append(compare_fn(flat.sort_by([("gram", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).combine_chunks()))
    if texts.num_rows < table.num_rows:
        found = bucket_fn(table.filter(alone), NONE)
        out.append(found.filter(pc.equal(found["state"], SETTLED)).select(["doc_id", "start", "n"]))
    return pa.concat_tables(out)


def by_gram(table: pa.Table) -> Iterator[pa.Table]:
    """The open runs of one bucket, gram by gram."""
    gram = table["gram"].to_numpy()
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(gram) != 0]), len(gram)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield table.slice(a, b - a)


def spans_table(doc: np.ndarray, at: np.ndarray) -> pa.Table:
    """SPANS of single windows (document, place), neighbours joined."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(at) > 1)] if len(doc) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    ends = np.r_[heads[1:], len(doc)] - 1 if len(doc) else heads
    return pa.table({"doc_id": pa.array(doc[heads], pa.int64()), "start": pa.array(at[heads], pa.int32()), "n": pa.array(at[ends] - at[heads] + 1, pa.int32())})
