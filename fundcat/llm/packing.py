"""Training sequences from pieces of power-of-two length.

A document's ids are cut into pieces of the longest length while they last and then into
one piece for each binary digit of the rest. A piece is a sequence of its own, so no
sequence crosses documents and none is padded; sequences of one length are numbered in a
row, and a batch is drawn from one length alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundcat.llm.common import cut, table
from fundcat.llm.repair import END, SENT, VOCABULARY, _word_ids

#: The longest sequence, a power of two.
LONGEST = 2048
#: Pieces that a task holds before it passes them on.
HELD = 20_000
_PIECES = "doc_id long, start long, length long, doc_tokens long, part int, place long, ids binary"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths that add up to ``n``: the longest again and again, then ever smaller powers
    of two, each once."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, vocabulary: str | None = None, end: int = END, longest: int = LONGEST) -> DataFrame:
    """Every document's pieces with their ids (little-endian unsigned 32-bit integers),
    the task that made them and their place among its pieces of that length."""
    import public_tokenizers

    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    stop = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        part, words = TaskContext.get().partitionId(), _word_ids(vocabulary)
        places: dict[int, int] = {}
        doc: list = []
        start: list[int] = []
        size: list[int] = []
        total: list[int] = []
        place: list[int] = []
        ids: list[bytes] = []

        def rows() -> pa.RecordBatch:
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(place, pa.int64()), pa.array(ids, pa.binary())]
            for held in (doc, start, size, total, place, ids):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "part", "place", "ids"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                flat = words.ids([text.as_py()])[0] + stop
                n, at = len(flat) // 4, 0
                for length in piece_lengths(n, longest):
                    doc.append(key)
                    start.append(at)
                    size.append(length)
                    total.append(n)
                    place.append(places.get(length, 0))
                    places[length] = place[-1] + 1
                    ids.append(flat[4 * at : 4 * (at + length)])
                    at += length
                    if len(doc) >= HELD:
                        yield rows()
        if doc:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``, one row per piece.
    Sequences are numbered without gaps, the longest first, so those of one length have
    consecutive numbers; ``offset`` is zero, as each piece fills its sequence.

    Pieces are written once and only counts by length and task are gathered: the number of
    the first sequence of each is two prefix sums, and no id crosses a shuffle.

    Null and empty texts are the end id alone, one sequence of one id. Rows with null or
    repeated ids are documents of their own, other columns are ignored, a very long
    document's pieces leave its task as they are made, and an empty table gives an empty
    result."""
    made = cut(pieces(docs, vocabulary, end, longest), "sequences")
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # one row a power of two
    buckets = counts.groupBy("length").agg(F.sum("rows").alias("rows")).select("length", F.coalesce(F.sum("rows").over(across), F.lit(0)).alias("bucket"))
    first = counts.select("length", "part", F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("before")).join(buckets, "length")
    first = first.select("length", "part", (F.col("bucket") + F.col("before")).alias("first"))
    first = cut(first, "firsts")
    # A start is 24 bytes; while they are few the pieces need not move.
    first = F.broadcast(first) if first.count() <= SENT else first
    return made.join(first, ["length", "part"]).select("doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def write_buckets(packed: DataFrame, path: str, rows_per_file: int = 65_536) -> None:
    """Write sequences as Parquet in one folder a length, ``rows_per_file`` consecutive
    sequences at most to a file. A length with most of the rows is spread over its files."""
    at = F.floor(F.col("sequence_id") / rows_per_file).alias("at")
    rows = packed.withColumn("at", at).repartition("length", "at").sortWithinPartitions("length", "at", "sequence_id").drop("at")
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("length").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype="<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, length, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), ids], names=["sequence_id", "ids"])

    rows = spark.read.parquet(path).where(F.col("length") == length)
    return rows.select("sequence_id", "ids").mapInArrow(run, "sequence_id long, ids array<int>")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
