"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch; bounds a Python worker's memory.
TEXT_BATCH = 512

#: A word: a run of characters other than space and \\t..\\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary
    one of our own only where the session has none and runs in one process (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not own:
        own = tempfile.mkdtemp(prefix="fundcat-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. Lineage ends
    there, so a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns made once: generated, so that neither a filter nor a later
    expression writes their expressions out again. Nothing is moved or written."""
    name = "_" + "_".join(df.columns)
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias(name)).select(f"`{name}`.*")


#: Names that ``row_key`` gives.
KEY = ("_key1", "_key2")


def key_names(docs: DataFrame) -> tuple[str, str]:
    """Names for ``row_key`` that no column has, whatever their case."""
    taken, names = {c.lower() for c in docs.columns}, KEY
    while taken & set(names):
        names = tuple(f"_{n}" for n in names)
    return names


def row_key(docs: DataFrame, names: tuple[str, str] = KEY) -> list[F.Column]:
    """128 bits of hash over all columns, nulls marked: with doc_id it tells rows apart
    whose doc_id is null or repeated. Only rows that are equal throughout share it."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    parts = [F.to_json(F.map_entries(c)) if kind.startswith("map") else c for c, (_, kind) in zip(cols, docs.dtypes, strict=True)]
    return [F.xxhash64(F.lit(i), *[c.isNull() for c in cols], *parts).alias(name) for i, name in enumerate(names)]


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` and ``row_key`` are in ``kept(doc_id, _key1, _key2)``, with
    the row key under ``key_names``."""
    names = key_names(docs)
    rows = docs.select("*", *row_key(docs, names))
    kept = kept.select(F.col("doc_id").alias("_kept"), *[F.col(k).alias(f"{k}_kept") for k in KEY])
    same = rows["doc_id"].cast("long").eqNullSafe(kept["_kept"])
    for name, k in zip(names, KEY, strict=True):
        same = same & (rows[name] == kept[f"{k}_kept"])
    return rows.join(kept, same, "left_semi")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Long texts travel to Python in batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc(col) -> F.Column:
    """Unsigned crc32 of a string's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(col, F.lit("")), "UTF-8"))
