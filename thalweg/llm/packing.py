"""Operator 6: variable-capacity best-fit packing of documents into sequences.

Tokens are words. Documents longer than the largest capacity are cut into
pieces of it. Pieces are dealt to groups of about GROUP by a hash, so that no
group grows with the corpus; each group is packed by best fit, longest piece
first. A piece that fits no open bin opens the size with the least cost for each
token that it can still be filled with, and at the end every bin shrinks to the
smallest permitted size that holds its contents.

Which pieces share a group, and so all bins, depends on the rows alone and not
on how the table is partitioned: rows equal in doc_id and text are counted, and
their copies numbered.

Defined results: a document without tokens (null or empty text) has one row
without a bin; repeated rows are packed each; rows without doc_id are packed;
pieces of equal length go in the order of doc_id, a hash of the text, place and
copy; a text of any length is cut, and only counted here; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP = 20_000
#: What a bin costs beside its tokens, and how much dearer a token of the longest sequence is.
OVERHEAD, LONG = 16.0, 0.1
SCHEMA = "doc_id bigint, piece int, piece_start bigint, piece_tokens int, bin_id bigint, bin_size int, bin_offset int"


def cost(size: int, capacities: tuple[int, ...]) -> float:
    return OVERHEAD + size * (1 + LONG * size / capacities[-1])


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """The bin and the offset of each piece, longest pieces given first; and the size of each bin."""
    spaces: list[tuple[int, int]] = []  # (free, bin) of open bins, in order
    bins, offsets, used = [], [], []
    left = sum(lengths)
    for n in lengths:
        left -= n
        at = bisect_left(spaces, (n, -1))
        if at < len(spaces):
            free, b = spaces.pop(at)
        else:
            # what follows is no longer than this piece, so nearly all the room can be filled
            size = min((c for c in capacities if c >= n), key=lambda c: cost(c, capacities) / (n + min(c - n, left)))
            free, b = size, len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(spaces, (free - n, b))
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """The bin, its size and the offset of every piece of docs (doc_id, text)."""
    most = capacities[-1]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n"))
    rows = rows.groupBy("doc_id", "text_id", "n").agg(F.count("*").alias("copies"))
    # copies in two steps, so that no array grows with their number
    rows = rows.withColumn("thousand", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1000))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("copies") - 1, F.col("thousand") * 1000 + 999)))).drop("thousand", "copies")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)), lambda i: F.struct(i.alias("piece"), (i.cast("bigint") * most).alias("piece_start"), F.least(F.lit(most), F.col("n") - i.cast("bigint") * most).cast("int").alias("piece_tokens")))
    pieces = rows.select("doc_id", "text_id", "copy", F.explode(cut).alias("x")).select("doc_id", "text_id", "copy", "x.*").checkpoint()
    full = pieces.filter("piece_tokens > 0")
    groups = max(1, -(-full.count() // GROUP))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece_tokens", "descending"), ("doc_id", "ascending"), ("text_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        bins, offsets, sizes = pack(table["piece_tokens"].to_pylist(), capacities)
        group = table["group"][0].as_py()
        return table.drop_columns(["group", "text_id", "copy"]).append_column("bin_id", pa.array([(group << 32) + b for b in bins], pa.int64())).append_column("bin_size", pa.array([sizes[b] for b in bins], pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int32()))

    group = F.pmod(F.xxhash64("doc_id", "text_id", "piece", "copy"), F.lit(groups)).cast("bigint")
    packed = full.withColumn("group", group).groupBy("group").applyInArrow(pack_group, SCHEMA)
    empty = pieces.filter("piece_tokens = 0").select("doc_id", "piece", "piece_start", "piece_tokens", *(F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "bigint"), ("bin_size", "int"), ("bin_offset", "int"))))
    return packed.unionByName(empty)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
