"""Shards by jump consistent hashing (Lamping and Veach)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundcat.llm.common import crc, cut, partitions, table

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. No table: a key's shard follows from the key
    and the count alone, and a further shard takes a share of each other one."""
    key = keys.astype(np.uint64).copy()
    shard, nxt = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def shard_of(key, shards: int) -> F.Column:
    """Jump hash of a long column as a Spark expression."""

    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return run(key)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``documents`` -> one row per input row with size, crc, shard, slot and the shard
    that it would have with one shard more.

    The law is ``key``: doc_id and the number of shards decide. Rows with the same
    doc_id share a shard, and all rows with a null doc_id do (their key is one
    constant). A null text has size 1 and crc 0. ``slot`` is gapless from 0 in each
    shard. To number a shard no task sees the whole of it: rows fall into buckets by a
    hash (with a number of the row, so that repeated rows spread), buckets are counted, and
    a row's slot is the count of the buckets before its own plus its place there. Texts are
    read once: what is known of a row is written before it is counted and numbered. An empty table gives an empty result; other columns are
    ignored."""
    buckets = max(64, partitions(docs.sparkSession))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc(F.col("text")).alias("text_crc32"),
    )
    key = F.xxhash64("doc_id")
    rows = rows.select("*", shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"))
    rows = cut(rows, "sharded")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    # shards * buckets rows at most, whatever the input.
    out = rows.withColumn("place", place).join(F.broadcast(starts), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as one folder per shard, under the law of ``shard``. Null
    texts and repeated rows are written as they are, an empty table gives an empty folder;
    a column of the documents named ``shard`` gives way to the shard."""
    placed = docs.withColumn("shard", shard_of(F.xxhash64(F.col("doc_id").cast("long")), shards))
    placed.write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARDS)


QUERIES = {"op2_sharding": op2_sharding}
ORACLES: dict[str, str] = {}
