"""SentencePiece encoding and decoding as relational work over a piece table.

Texts fall into units that no piece reaches across. Each distinct unit is encoded
once: its substrings of bounded length are exploded, an equi-join to the piece table
leaves the edges of the unit's lattice, the edges are grouped by unit, and a
higher-order ``aggregate`` folds them into a path. ``fold="viterbi"`` takes the path
of the largest summed score, as unigram models need. The vocabulary here is a BPE
model, whose pieces are merge ranks and whose right segmentation is not the best sum;
``fold="merge"`` folds the same edges from the best score down and takes each merge
whose two halves stand, which is the library's result for a BPE vocabulary.

Units that are frequent in a bounded sample are encoded first and travel to the texts.
A text is read once: it becomes the ids of these units, with marks where other units
stand, and crosses one shuffle so. All other units of all texts are then encoded, each
once, and come to the marks: the sample decides which way a unit goes, never what it
becomes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundcat.llm.common import cut, partitions, small_batches, table

MODEL = "piece_bpe_32k.model"
#: Distinct frequent units that are sent to every worker, and the documents (about so
#: many) that they are counted in.
FREQUENT, SAMPLE = 400_000, 25_000
#: The lattice of a unit grows with its length and the fold with the square of it, so
#: longer units are merged by a heap where their texts are, with the same result. Units
#: are cut first wherever no piece has the two characters that meet, so that runs of
#: digits, marks or mixed scripts are never long; only runs of one script's letters are.
LONGEST = 48
#: Substrings of more characters than this are looked for only where some piece begins
#: with their first ``HEAD`` characters, and no longer than the longest that does.
HEAD = 3
#: Units that a worker keeps besides those that are sent to it.
UNITS = 400_000
#: Letters that end a unit before anything else: Latin, Greek and Cyrillic.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯͰ-ͳͶͷͻ-ͽΆΈ-ϿЀ-ҁҊ-ԯḀ-ỿ"
SPACE = "▁"
_UNIT = re.compile(rf"{SPACE}*[^{SPACE}\n{LETTERS}]*[{LETTERS}]+|{SPACE}*[^{SPACE}\n{LETTERS}]+|{SPACE}+|\n")


def _hash(s: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    return np.uint64(xxhash.xxh64_intdigest(s.encode(), 42)).astype(np.int64).item()


@dataclass(frozen=True)
class Model:
    """What is needed of a model file: scores and ids of the pieces that may be used,
    the id of byte 0 and the id of an unknown symbol."""

    pieces: dict[str, tuple[int, float]]
    byte0: int
    texts: tuple[bytes, ...]

    @staticmethod
    def load(path: str | None = None) -> Model:
        import public_tokenizers
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        usable = {names[i]: (i, m.get_score(i)) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        split = re.compile(rf"[{LETTERS}][^{LETTERS}]|[^{SPACE}]{SPACE}|\n")
        if across := [p for p in usable if split.search(p)]:
            raise ValueError(f"pieces reach across units: {across[:3]}")
        texts = [b"" if m.is_control(i) or m.is_unknown(i) else bytes([i - names.index("<0x00>")]) if m.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        return Model(usable, names.index("<0x00>"), tuple(texts))

    @cached_property
    def pairs(self) -> frozenset[str]:
        """Neighbouring characters inside a piece: no merge crosses any others."""
        return frozenset(p[i : i + 2] for p in self.pieces for i in range(len(p) - 1))

    @property
    def mark(self) -> int:
        """What stands for a unit whose ids are not known yet: the number after the ids."""
        return len(self.texts)

    @property
    def code(self) -> str:
        """How an id or a mark is held as bytes."""
        return ">u2" if self.mark < 1 << 16 else ">u4"

    def heads(self, spark: SparkSession) -> DataFrame:
        """``(head, most)``: Spark's hash of the first ``HEAD`` characters of pieces, and
        the length of the longest piece that begins so. Heads that share a hash only make
        ``most`` larger than need be."""
        most: dict[int, int] = {}
        for p in self.pieces:
            if len(p) >= HEAD:
                h = _hash(p[:HEAD])
                most[h] = max(most.get(h, 0), len(p))
        return spark.createDataFrame(pd.DataFrame(list(most.items()), columns=["head", "most"]), "head long, most int")

    def table(self, spark: SparkSession) -> DataFrame:
        """``(key, piece, id, score)`` with Spark's 64-bit hash of the piece."""
        rows = [(_hash(p), p, i, s) for p, (i, s) in self.pieces.items()]
        if len({r[0] for r in rows}) < len(rows):
            raise ValueError("two pieces share a hash")
        return spark.createDataFrame(pd.DataFrame(rows, columns=["key", "piece", "id", "score"]), "key long, piece string, id int, score double")


def _split(unit: str, pairs: frozenset[str]) -> list[str]:
    """A unit cut wherever the two characters that meet are in no piece."""
    if pairs.issuperset(map(add, unit, unit[1:])):
        return [unit]
    at = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pairs]
    return [unit[i:j] for i, j in zip([0, *at], [*at, len(unit)], strict=True)]


def _found(text: str | None) -> list[str]:
    """The units of a text before they are split."""
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Units(dict):
    """What a unit becomes: its ids as bytes, or, where not all of its parts are known,
    the parts' ids and the parts that are not known."""

    def __init__(self, known: dict[str, bytes], model: Model) -> None:
        super().__init__(known)
        self.known, self.model, self.most = known, model, len(known) + UNITS
        self.longest, self.pairs = max(map(len, model.pieces)), model.pairs
        self.mark = np.array(model.mark, dtype=model.code).tobytes()

    def part(self, u: str) -> bytes | str:
        """Ids of a part that is known or too long for the lattice, or else the part."""
        if len(u) <= LONGEST:
            return self.known.get(u, u)
        return np.array(merge_text(u, self.model.pieces, self.model.byte0, self.longest), dtype=self.model.code).tobytes()

    def __missing__(self, unit: str) -> bytes | tuple[bytes | str, ...]:
        parts = tuple(map(self.part, _split(unit, self.pairs)))
        out = parts if str in map(type, parts) else b"".join(parts)
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        self[unit] = out
        return out

    def read(self, text: str | None) -> tuple[bytes, list[int], list[str]]:
        """Ids of a text with marks, the units that are not known, each once, and the
        place among them of each mark's unit."""
        parts = [*map(self.__getitem__, _found(text))]
        places: dict[str, int] = {}
        marks: list[int] = []
        for at in [i for i, p in enumerate(parts) if type(p) is tuple]:
            marks += [places.setdefault(x, len(places)) for x in parts[at] if type(x) is str]
            parts[at] = b"".join([self.mark if type(x) is str else x for x in parts[at]])
        return b"".join(parts), marks, list(places)


class Codes:
    """Ids with marks, compressed. They are held by how frequent they are, so that most
    of their high bytes are zero, and the bytes of one place stand together."""

    def __init__(self, model: Model, order: np.ndarray) -> None:
        self.code, self.size = model.code, np.dtype(model.code).itemsize
        self.mark, self.order = model.mark, order
        self.rank = np.empty(len(order), dtype=model.code)
        self.rank[order] = np.arange(len(order))
        self.squeeze, self.open_up = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress

    def pack(self, raw: bytes, marks: list[int]) -> bytes:
        if not raw:
            return b""
        # Units mostly come in the order of their marks, so differences are ones.
        steps = np.diff(np.array(marks, dtype="<i4"), prepend=-1).astype("<i4").tobytes()
        return self.squeeze(steps + self.rank[np.frombuffer(raw, dtype=self.code)].view(np.uint8).reshape(-1, self.size).T.tobytes())

    def ids(self, data: bytes, marks: int, found: list[bytes]) -> np.ndarray:
        """The ids, with ``found`` in the place of the marks."""
        if not data:
            return np.zeros(0, dtype=self.code)
        data = self.open_up(data)
        ranks = np.frombuffer(data, dtype=np.uint8, offset=4 * marks).reshape(self.size, -1).T.copy().view(self.code)[:, 0]
        ids = self.order[ranks].astype(self.code)
        if not marks:
            return ids
        raw, out, last = ids.tobytes(), [], 0
        for at, k in zip((np.flatnonzero(ids == self.mark) * self.size).tolist(), (np.cumsum(np.frombuffer(data, dtype="<i4", count=marks)) - 1).tolist(), strict=True):
            out += raw[last:at], found[k]
            last = at + self.size
        return np.frombuffer(b"".join([*out, raw[last:]]), dtype=self.code)


def units(docs: DataFrame, model: Model) -> DataFrame:
    """Distinct units of all texts, with their counts: ``(unit, n)``."""
    pairs = model.pairs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            n: Counter[str] = Counter()
            for unit, k in found.items():
                for u in _split(unit, pairs):
                    n[u] += k
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["unit", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                found.update(_found(text))
            if len(found) > UNITS:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """``(unit, n)`` -> ``(unit, n, edges)``: every piece inside the unit as
    ``(down, i, j, id)`` with ``down`` the negative score, sorted, and a row without
    an id for each character that is no piece. ``words`` stays partitioned by unit, so
    neither the join (the piece table is a vocabulary, of bounded size) nor the
    grouping moves it."""
    starts = words.select("unit", "n", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("i"))
    starts = starts.withColumn("head", F.xxhash64(F.substring("unit", F.col("i") + 1, F.lit(HEAD)))).join(F.broadcast(model.heads(words.sparkSession)), "head", "left")
    reach = F.least(F.coalesce("most", F.lit(HEAD - 1)), F.length("unit") - F.col("i"))
    spans = starts.select("unit", "n", "i", F.explode(F.sequence(F.lit(1), reach)).alias("l"))
    spans = spans.select("unit", "n", "i", "l", F.substring("unit", F.col("i") + 1, F.col("l")).alias("part"))
    # A 64-bit hash is a far quicker key to look up than a string; strings are compared
    # where hashes meet, and no two pieces share one.
    spans = spans.withColumn("key", F.xxhash64("part"))
    edges = spans.join(F.broadcast(model.table(words.sparkSession)), "key", "left").where("part = piece or l = 1")
    edges = edges.select("unit", "n", "i", "l", F.when(F.col("part") == F.col("piece"), F.col("id")).alias("id"), F.when(F.col("part") == F.col("piece"), -F.col("score")).alias("down"))
    edge = F.struct("down", "i", (F.col("i") + F.col("l")).alias("j"), "id")
    return edges.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def merge_fold(edges, size) -> F.Column:
    """Ends of the segments of a BPE vocabulary: edges from the best score down,
    leftmost first; an edge is taken if it joins two neighbouring segments."""

    def step(ends, e):
        at = F.array_position(ends, e["i"]).cast("int")
        return F.when((at > 0) & F.get(ends, at + 1).eqNullSafe(e["j"]), F.array_remove(ends, F.get(ends, at))).otherwise(ends)

    longer = F.filter(edges, lambda e: e["j"] > e["i"] + 1)
    return F.aggregate(longer, F.sequence(F.lit(0), size), step)


def viterbi_fold(edges, size, unknown: float) -> F.Column:
    """Ends of the segments with the largest summed score. Edges are folded by their
    end; the state holds the best (score, path) of every position so far. A character
    that is no piece scores ``unknown``."""
    kind = "array<struct<score:double,path:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path"))).cast(kind)

    def reach(best, j):
        into = F.filter(edges, lambda e: e["j"] == j)
        ways = F.transform(into, lambda e: F.struct((F.get(best, e["i"])["score"] - F.coalesce(e["down"], F.lit(-unknown))).alias("score"), F.concat(F.get(best, e["i"])["path"], F.array(j)).alias("path")))
        return F.concat(best, F.array(F.array_max(ways)).cast(kind))

    return F.aggregate(F.sequence(F.lit(1), size), start, reach, lambda best: F.element_at(best, -1)["path"])


def path_ids(edges, ends, unit, byte0: int) -> F.Column:
    """Ids along a path; a character that is no piece gives its bytes' ids."""

    def raw(i):
        text = F.hex(F.encode(F.substring(unit, i + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda b: F.conv(F.substring(text, 2 * b + 1, F.lit(2)), 16, 10).cast("int") + byte0)

    # An edge is on the path if the end after its start is its own; a start is found by
    # its place among the ends, 0 for none, and no edge ends at 0.
    on = F.filter(edges, lambda e: F.get(ends, F.array_position(ends, e["i"]).cast("int")) == e["j"])
    steps = F.array_sort(F.transform(on, lambda e: F.struct(e["i"].alias("i"), e["id"].alias("id"))))
    return F.flatten(F.transform(steps, lambda s: F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(raw(s["i"]))))


def merge_text(text: str, pieces: dict[str, tuple[int, float]], byte0: int, longest: int) -> list[int]:
    """BPE of one long unit by a heap of merges over a linked list. ``longest`` is the
    length of the longest piece."""
    n = len(text)
    stop, left = [*range(1, n + 1)], list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> tuple[float, int, int, int] | None:
        j = stop[i]
        return (-pieces[p][1], i, j, stop[j]) if j < n and stop[j] - i <= longest and (p := text[i : stop[j]]) in pieces else None

    heap = [x for i in range(n) if (x := pair(i))]
    heapify(heap)
    while heap:
        _, i, j, k = heappop(heap)
        if not alive[i] or stop[i] != j or not alive[j] or stop[j] != k:
            continue
        alive[j] = False
        stop[i] = k
        if k < n:
            left[k] = i
        for at in (i, left[i]):
            if at >= 0 and (x := pair(at)):
                heappush(heap, x)
    ids: list[int] = []
    for i in range(n):
        if alive[i]:
            p = text[i : stop[i]]
            ids += [pieces[p][0]] if p in pieces else [byte0 + b for b in p.encode("utf-8", "replace")]
    return ids


def encode_units(words: DataFrame, model: Model) -> DataFrame:
    """``(unit, n)``, partitioned by unit, of at most ``LONGEST`` characters ->
    ``(unit, n, ids)``, partitioned alike."""
    # Edges of so many units are gathered in memory before Spark goes over to sorting.
    words.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    graph = lattice(words, model).withColumn("ends", merge_fold(F.col("edges"), F.length("unit")))
    return graph.select("unit", "n", path_ids(F.col("edges"), F.col("ends"), F.col("unit"), model.byte0).alias("ids"))


def _dealt(words: DataFrame) -> DataFrame:
    """By unit, over so many partitions that their lattices stay small."""
    return words.repartition(4 * partitions(words.sparkSession), "unit")


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` units with the largest counts. Only counts of counts decide,
    so nothing is sorted whole."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("units")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 30
    for s in steps:
        if (total := total + s["units"]) > most:
            break
        least = s["step"]
    return counted.where(step >= least)


def _packed(ids, model: Model) -> F.Column:
    """Ids as the hex digits of the model's code."""
    digits = 2 * np.dtype(model.code).itemsize
    return F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), digits, "0")), "")


def _known(rows: DataFrame, model: Model, frequent: int, sample: int) -> tuple[dict[str, bytes], np.ndarray]:
    """Ids of units that are frequent in a sample of rows; all ids, the most frequent
    there first, after the mark."""
    total = rows.count()
    some = rows if total <= sample else rows.sample(sample / total, seed=1)
    chosen = _frequent(cut(units(some, model), "units").where(F.length("unit") <= LONGEST), frequent)
    found = encode_units(_dealt(chosen), model).select("unit", "n", _packed(F.col("ids"), model).alias("ids"))
    known, times = {}, np.zeros(model.mark + 1, dtype=np.int64)
    for u, n, i in cut(found, "frequent").toLocalIterator(prefetchPartitions=False):
        known[u] = bytes.fromhex(i)
        np.add.at(times, np.frombuffer(known[u], dtype=model.code), n)
    times[model.mark] = np.iinfo(np.int64).max
    return known, np.argsort(-times, kind="stable")


def encode(docs: DataFrame, path: str | None = None, frequent: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """``documents`` -> ``(doc_id, n_pieces, ids, round_trip)``, one row per input row.

    Null and empty texts have no pieces. ``round_trip`` tells that decoding the ids
    gives the text back (its 128-bit digest). Repeated rows keep their repeats; other
    columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    model = Model.load(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, order = _known(rows, model, frequent, sample)
    sent = spark.sparkContext.broadcast((known, model, order))
    # Rows that share a key share the units sent to them, which does no harm; rows
    # without text have no units, so any key will do.
    rows = rows.withColumn("key", F.when(F.length("text") > 0, F.xxhash64("doc_id", "text")).otherwise(F.monotonically_increasing_id()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, order = sent.value
        read, pack = Units(known, model).read, Codes(model, order).pack
        for b in batches:
            texts = b.column("text").to_pylist()
            data, marks, open_ = [], [], []
            for raw, m, u in map(read, texts):
                data.append(pack(raw, m))
                marks.append(len(m))
                open_.append(u)
            digests = [_digest((t or "").encode()) for t in texts]
            arrays = [b.column("key"), b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(data, pa.binary()), pa.array(marks, pa.int32()), pa.array(open_, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "digest", "data", "marks", "units"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, model, order = sent.value
        fill, names = Codes(model, order).ids, model.texts.__getitem__
        for b in batches:
            ids, good = [], []
            for digest, data, marks, n, own in zip(*[b.column(c).to_pylist() for c in ("digest", "data", "marks", "n", "own")], strict=True):
                # Equal rows share a key: each of their units comes as often as they do.
                found = [x[4:] for x in own[:: len(own) // n]] if n else []
                ids.append(fill(data, marks, found).astype(np.int32))
                raw = b"".join(map(names, ids[-1].tolist()))
                good.append(_digest(raw[1:] if raw.startswith(b" ") else raw) == digest)
            n = np.array([len(i) for i in ids], dtype=np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(ends, flat), pa.array(good, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    # Texts cross one shuffle, from which both their unknown units and they themselves
    # are read: what is generated keeps the columns of the two reads alike.
    read = rows.mapInArrow(first, "key long not null, doc_id long, digest binary, data binary, marks int, units array<string>").repartition(partitions(spark), "key")
    read = read.select("key", F.explode(F.array(F.struct("doc_id", "digest", "data", "marks", "units"))).alias("row"))
    # Units cross another, from which both their distinct ones and the way back to the
    # texts are read: the filter does the same there.
    dealt = _dealt(read.where("row.marks > 0").select("key", F.posexplode("row.units").alias("pos", "unit")))
    words = dealt.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key"), F.max("pos").alias("last")).where("key is not null and last >= 0")
    found = encode_units(words.select("unit", "n"), model).select("unit", _packed(F.col("ids"), model).alias("data"))
    # Both sides are dealt alike and a task's distinct units are few, so nothing is sorted
    # but a text's own units, by their places in the list of those that it misses.
    at = F.lpad(F.hex("pos"), 8, "0")
    extra = dealt.join(found.hint("shuffle_hash"), "unit").select("key", F.unhex(F.concat(at, "data")).alias("data"))
    own = extra.repartition(partitions(spark), "key").groupBy("key").agg(F.sort_array(F.collect_list("data")).alias("own"))
    full = read.join(own.hint("shuffle_hash"), "key", "left").select("row.doc_id", "row.digest", "row.data", "row.marks", F.size("row.units").alias("n"), "own")
    return full.mapInArrow(whole, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def _digest(text: bytes) -> bytes:
    return blake2b(text, digest_size=16).digest()


def plain(raw: bytes) -> str:
    """The text of pieces: without the leading space that encoding adds."""
    out = raw.decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def decode_ids(ids: list[int], texts) -> str:
    """The text of ids: pieces with marks as spaces, and bytes as bytes."""
    return plain(b"".join(map(texts.__getitem__, ids)))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, text)``; null ids give null."""
    texts = list(Model.load(path).texts)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_ids(list(x), texts) for x in ids])

    return encoded.select("doc_id", run("ids").alias("text"))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
