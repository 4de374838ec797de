"""SimHash near-duplicates with a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of their bit counts. The Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints, so it is a lower bound. A range join of
radius r over a grid finds the candidates: the segments form r + 2 bands, and vectors
within Manhattan distance r agree wholly in two bands at least, so they share a grid cell
of one of the pairs of bands. Candidates that pass the Manhattan bound are verified
exactly. A cell has a third of the segments, so on random prints it holds some
1 / 35,000 of them; dense groups of near copies share all their cells.

Counts 0, 1, 2 are written in unary (00, 01, 11), which makes the Manhattan distance
of two embeddings the number of differing bits, and a band's cell a bit mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import KEY, cut, keep_rows, key_names, partitions, row_key, small_batches, table
from fundcat.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Rows of one grid cell that one task compares with each other; larger cells are cut
#: into blocks, and each pair of blocks is a task of its own.
BLOCK = 2048
#: Links gathered in a task before it goes over to one search per vertex.
DENSE = 16
#: Rows of a block that are compared as vectors over many blocks at once.
SHORT = 64

_ODD = 0x5555555555555555
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer; 0 for null, empty or wordless text."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    spans = zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    one = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), 0
    while part := [one(joined[i:j], seed) for i, j in islice(spans, 1 << 16)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` for every row, fp being the 64 bits as a signed long, and the
    columns ``carried``, which are longs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64), **{c: b[c] for c in carried}})

    schema = ", ".join(["doc_id long, fp long", *[f"{c} long" for c in carried]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInPandas(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp) -> F.Column:
    """Bit counts of the 32 segments, in unary, as one long."""
    nxt, odd = F.shiftrightunsigned(fp, 1), F.lit(_ODD)
    return F.shiftleft(fp.bitwiseAND(nxt).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseOR(nxt).bitwiseAND(odd))


def bands(radius: int) -> list[int]:
    """Masks over the 32 segments: each pair of radius + 2 bands."""
    cuts = [32 * i // (radius + 2) for i in range(radius + 3)]
    one = [sum(3 << 2 * s for s in range(i, j)) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [_signed(a | b) for a, b in combinations(one, 2)]


def _forest(fp: np.ndarray, emb: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links among ``fp`` that connect whatever the full set of links connects."""
    n, left, right = len(fp), [], []
    for i in range(0, n, 256):
        near = np.bitwise_count(emb[i : i + 256, None] ^ emb[None, i:]) <= radius
        a, b = np.nonzero(near)
        keep = b > a
        a, b = a[keep] + i, b[keep] + i
        keep = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        left += a[keep].tolist()
        right += b[keep].tolist()
        if len(left) > DENSE * n:
            break
    else:
        return left, right
    left, right, todo = [], [], np.arange(n)
    while len(todo):
        stack, todo = [int(todo[0])], todo[1:]
        while stack and len(todo):
            at = stack.pop()
            near = np.bitwise_count(emb[todo] ^ emb[at]) <= radius
            near[near] = np.bitwise_count(fp[todo[near]] ^ fp[at]) <= radius
            found, todo = todo[near].tolist(), todo[~near]
            left += [at] * len(found)
            right += found
            stack += found
    return left, right


def _pairs(place: np.ndarray, fp: np.ndarray, emb: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links among rows that are sorted by their place in the grid. Short runs are
    compared all at once, each row with the next, the one after it, and so on."""
    cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
    starts, stops = np.append(0, cuts), np.append(cuts, len(place))
    long_run = stops - starts > SHORT
    left, right = [], []
    for i, j in zip(starts[long_run].tolist(), stops[long_run].tolist(), strict=True):
        a, b = _forest(fp[i:j], emb[i:j], radius)
        left.append(fp[i:j][a])
        right.append(fp[i:j][b])
    short = np.repeat(~long_run, stops - starts)
    at, end = np.flatnonzero(short), np.repeat(stops, stops - starts)[short]
    for step in range(1, SHORT):
        at, end = at[at + step < end], end[at + step < end]
        if not len(at):
            break
        near = at[np.bitwise_count(emb[at] ^ emb[at + step]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        left.append(fp[near])
        right.append(fp[near + step])
    return left, right


def grid(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints(fp)`` -> ``(fp, emb, band, cell)``, a row for each pair of bands."""
    cells = F.array(*[F.struct(F.lit(k).alias("band"), F.col("emb").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(bands(radius))])
    return prints.select("fp", embedding(F.col("fp")).alias("emb")).withColumn("at", F.explode(cells)).select("fp", "emb", "at.band", "at.cell")


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``prints(fp)``, distinct -> ``(a, b)``: pairs within ``radius`` bits that
    connect all that are linked. Within a block only a spanning forest is kept once
    the links outgrow the block, so a dense group never becomes all its pairs."""
    small_batches(prints.sparkSession, 1 << 14)
    rows = grid(prints, radius)
    sizes = rows.groupBy("band", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    # Few cells are large; Spark broadcasts them if they are small enough, and joins if not.
    rows = rows.join(sizes, ["band", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select(F.xxhash64("band", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "fp", "emb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _pairs(cols[0], cols[1].view(np.uint64), cols[2].view(np.uint64), radius)
            ends = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("place", "fp", "emb"), strict=True)]
            # The last run may go on in the next batch.
            cut_at = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            held = [c[cut_at:] for c in cols]
            if cut_at:
                yield found([c[:cut_at] for c in cols])
        if len(held[0]):
            yield found(held)

    # Blocks whose places share a hash are compared with each other too, which adds no
    # wrong link: each is verified.
    dealt = rows.repartition(partitions(prints.sparkSession), "place").sortWithinPartitions("place")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``documents`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Exact copies share a fingerprint and count once in the search. Repeated
    rows keep their repeats. A null doc_id is carried through; ``component_id`` is the
    smallest doc_id that is not null in the component, null if there is none. Other
    columns are ignored. An empty table gives an empty result."""
    prints = cut(fingerprints(docs), "fingerprints")
    texts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(texts, radius)).withColumnRenamed("node", "fp")
    labelled = cut(texts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "labels")
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(by_fp, "fp").select("doc_id", hexed, "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``documents`` without all but one row of each component: the one with the
    smallest doc_id stays, null ones last, then that with the smallest row key. Columns
    are unchanged, whatever their names. Rows of different components all stay, whatever their doc_id; of rows
    that are equal throughout one stays."""
    prints = cut(fingerprints(docs.select("doc_id", "text", *row_key(docs)), carried=KEY), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)).alias("first")
    texts = cut(prints.groupBy("fp").agg(first), "prints")
    roots = components(links(texts)).withColumnRenamed("node", "fp")
    kept = texts.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = cut(kept.select("first.doc_id", *[f"first.{k}" for k in KEY]), "survivors")
    out = keep_rows(docs, kept)
    repeats = prints.groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeats.isEmpty():
        out = out.dropDuplicates(["doc_id", *key_names(docs)])
    return out.select(*[f"`{c}`" for c in docs.columns])


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLES: dict[str, str] = {}
