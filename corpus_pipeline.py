"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

Toxicity and the mixing classifier learn from the labels table, held-out rows
included, since here they only filter; the toxicity stage rejects documents at the operator's threshold, near-duplicates keep the
smallest doc_id of each group by shingles of five words (rows that repeat doc_id
and text stay once, unlike texts of one doc_id are judged each by itself), secrets are replaced in
the text, mixing repeats a document as often as its rate says (the fraction by
chance), packing returns the place of every piece. Rows without doc_id pass all
stages; null and empty texts pass the first three; a stage takes an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import minhash_dedup, mixing, packing, secret_scan, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    lexicon = toxicity.learn_lexicon(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, lexicon).filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("text_id", minhash_dedup.text_id())
    gone = minhash_dedup.near_duplicates(docs, 5).filter("not kept").select("doc_id", "text_id").distinct()
    # repeated rows of a doc_id are one document, unlike texts of it are documents of their own
    once = docs.filter("doc_id is not null").join(gone, ["doc_id", "text_id"], "left_anti").groupBy("doc_id", "text_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return once.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS), mixing.by_quality(_labels(spark, sf_dir)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express none of the stages; tests/llm/test_pipeline.py holds each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
