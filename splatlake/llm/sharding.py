"""Operator 2: a reproducible global shuffle whose shard and slot can be computed.

Every row gets a dense global row number; a keyed Feistel network with cycle walking permutes 0..n-1; the permuted
number p gives shard p mod k and slot p div k. Shard sizes therefore differ by one row at most, and slots have no gaps.

Rows that agree in id, text checksum and size are interchangeable; they are counted first and numbered together, so repeated rows, for instance empty
texts without an id, fill no bucket. Row numbers come from 4,096 hash buckets of these groups: a row's number is its bucket's offset, plus the rows of the groups before its own in the
bucket by id, checksum and size, plus its rank in its group. Only the 4,096 counts are broadcast; large groups are dealt out in parts of ``PART`` rows.
Null ids are rows like any other. A null text counts as empty, texts of any length are taken whole. An empty table gives an empty result. Only the id and the text are read, so
extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BUCKETS = 4096
ROUNDS = 8
PART = 1 << 16


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of x with a round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``numbers``."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [((seed + 1) * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64 for r in range(ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        return (left << half) | right

    out = network(numbers.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def _feistel(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = permute(batch.column(3).to_numpy(), batch.column(4)[0].as_py(), seed)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], ["id", "size", "text_crc32", "p"])

    return run


def assign_shards(docs: DataFrame, n_shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    groups = rows.groupBy("id", "text_crc32", "size").agg(F.count("*").alias("rows"))
    groups = materialise(groups.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int")))
    counts = groups.groupBy("bucket").agg(F.sum("rows").alias("count"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"),
                            F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))

    rank = F.sum("rows").over(Window.partitionBy("bucket").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = groups.withColumn("rank", F.coalesce(rank, F.lit(0))).join(F.broadcast(offsets), "bucket")
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(PART).cast("long"))))
    if groups.where(F.col("rows") > PART).limit(1).count():
        parts = parts.repartition("id", "text_crc32", "size", "part")
    each = F.explode(F.sequence(F.col("part"), F.least(F.col("part") + F.lit(PART - 1), F.col("rows") - 1)))
    placed = parts.withColumn("k", each).select("id", "size", "text_crc32", (F.col("offset") + F.col("rank") + F.col("k")).cast("long").alias("number"), "n").mapInArrow(_feistel(seed), f"id {docs.schema[id_col].dataType.simpleString()}, size long, text_crc32 long, p long")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", (F.col("p") % n_shards).cast("int").alias("shard"), F.expr(f"p div {int(n_shards)}").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """24 shards of ``documents`` under the law ``rows``."""
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
