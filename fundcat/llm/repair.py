"""Token ids in Re-Pair compressed shards.

A shard holds the ids of consecutive documents. Pairs of neighbouring symbols that
occur often are replaced by new symbols (nonterminals), round after round, and the
shard keeps the rules and the length that each symbol expands to. No rule spans two
documents, so a document, or any position in it, is decoded without the rest.

File format: Parquet, one row per shard, ``part`` and ``seq`` in ascending doc_id
order, counts, and ``payload``: the magic ``RPG1``, little-endian unsigned 32-bit
counts (documents, rules, symbols, first nonterminal), the symbols per document
(u32), the rules' left and right symbols (u32 each), the expansion length of each
rule (u32), and the symbols (u16 if all fit, else u32).
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundcat.llm.common import partitions, shared_dir, small_batches, table

END = 1
VOCABULARY = "word_bpe_49k.json"
#: Ids gathered before a shard is closed; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: The least occurrences of a pair that gets a rule, the least that are replaced in the
#: end (a rule takes 12 bytes, an occurrence saves 2), and the rules that one round adds,
#: the most frequent pairs first. Rounds go on until no pair is left.
LEAST, PAYS, ROUND_RULES = 32, 7, 4096
#: Shards whose starts are sent to all tasks; those of more shards are joined.
SENT = 200_000
#: Distinct words whose ids a worker keeps.
CACHE = 1_200_000
_SLOT_BITS = 18
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: ASCII marks without the apostrophe, which may start a token with the letters behind it.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


# ---- grammar -----------------------------------------------------------------


def _frequent(key: np.ndarray, least: int, most: int) -> np.ndarray:
    """Keys that occur ``least`` times or more, from the rarest to the most frequent, and
    no more than ``most`` of them."""
    if not len(key):
        return key
    ordered = np.sort(key)
    ends = np.flatnonzero(ordered[1:] != ordered[:-1])
    ends = np.append(ends, len(ordered) - 1)
    n = np.diff(ends, prepend=-1)
    heavy = np.flatnonzero(n >= least)
    return ordered[ends[heavy[np.argsort(n[heavy], kind="stable")]]][-most:]


def compress(symbols: np.ndarray, last: np.ndarray, first_new: int, least: int = LEAST, pays: int = PAYS, most: int = ROUND_RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs until none is left. ``last`` marks the end of each
    document. Returns the symbols, their end marks and the rules (n, 2), rule k being
    ``first_new + k``. A round takes the ``most`` frequent pairs, 32767 at most."""
    seq, rules, top = symbols.astype(np.uint32), [], first_new
    while len(seq) > 1:
        # Two 16-bit symbols fit a 32-bit key, which sorts twice as fast.
        wide = np.uint64 if max(top, int(seq.max()) + 1) > 1 << 16 else np.uint32
        half, high = wide(wide(0).nbytes * 4), wide(wide(0).nbytes * 8 - _SLOT_BITS)
        mixer = wide(0x9E3779B97F4A7C15 >> (64 - wide(0).nbytes * 8))
        key = (seq[:-1].astype(wide) << half) | seq[1:]
        inside = ~last[:-1]
        chosen = _frequent(key[inside], least, most)
        if not len(chosen):
            break
        # Of chosen pairs that share a slot the most frequent is written last and stays;
        # the others have their turn in a later round.
        rule = np.full(1 << _SLOT_BITS, -1, dtype=np.int16)
        rule[(chosen * mixer) >> high] = np.arange(len(chosen))
        found = rule[(key * mixer) >> high]
        at = np.flatnonzero((found >= 0) & inside)
        of = found[at]
        same = chosen[of] == key[at]
        at, of = at[same], of[same]
        # Runs of overlapping matches: every other one, from the left.
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - start) % 2 == 0
        at, of = at[odd], of[odd]
        used = np.bincount(of, minlength=len(chosen)) >= pays
        at, of = at[used[of]], of[used[of]]
        if not len(at):
            break
        seq[at] = top + (np.cumsum(used) - 1)[of]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        last = last.copy()
        last[at] = last[at + 1]
        seq, last = seq[keep], last[keep]
        taken = chosen[used]
        rules.append(np.stack([taken >> half, taken & ((wide(1) << half) - wide(1))], axis=1).astype(np.int64))
        top += int(used.sum())
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)


def layers(rules: np.ndarray, first_new: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that use none of their own stretch, from the first on."""
    done = 0
    while done < len(rules):
        ready = (rules[done:] < first_new + done).all(axis=1)
        stop = done + (int(np.argmin(ready)) if not ready.all() else len(ready))
        yield done, stop
        done = stop


def lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """Expansion length of each rule; a rule uses only earlier ones."""
    out = np.ones(len(rules), dtype=np.int64)
    for done, stop in layers(rules, first_new):
        part = rules[done:stop]
        out[done:stop] = np.where(part >= first_new, out[np.maximum(part - first_new, 0)], 1).sum(axis=1)
    return out


def expand(seq: np.ndarray, rules: np.ndarray, first_new: int) -> np.ndarray:
    """The ids that a run of symbols stands for."""
    seq = seq.astype(np.int64)
    while len(at := np.flatnonzero(seq >= first_new)):
        width = np.ones(len(seq), dtype=np.int64)
        width[at] = 2
        where = np.cumsum(width) - width
        out = np.repeat(seq, width)
        pairs = rules[seq[at] - first_new]
        out[where[at]], out[where[at] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq.astype("<u4")


def pack(ids: list[bytes], first_new: int) -> bytes:
    """A shard's payload from its documents' ids (little-endian u32 bytes, none empty)."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    last = np.zeros(len(flat), dtype=bool)
    last[np.cumsum([len(x) // 4 for x in ids]) - 1] = True
    seq, last, rules = compress(flat, last, first_new)
    ends = np.flatnonzero(last) + 1
    head = struct.pack("<4s4I", b"RPG1", len(ids), len(rules), len(seq), first_new)
    kind = "<u2" if first_new + len(rules) <= 1 << 16 and (not len(seq) or seq.max() < 1 << 16) else "<u4"
    parts = [np.diff(ends, prepend=0).astype("<u4"), rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), lengths(rules, first_new).astype("<u4"), seq.astype(kind)]
    return head + b"".join(x.tobytes() for x in parts)


class Shard:
    """A payload that has been read."""

    def __init__(self, payload: bytes) -> None:
        magic, docs, n_rules, symbols, self.first_new = struct.unpack_from("<4s4I", payload)
        if magic != b"RPG1":
            raise ValueError("not a token shard")
        at = struct.calcsize("<4s4I")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.ends = np.cumsum(take(docs, "<u4"), dtype=np.int64)
        self.rules = np.stack([take(n_rules, "<u4"), take(n_rules, "<u4")], axis=1).astype(np.int64)
        self.lengths = take(n_rules, "<u4").astype(np.int64)
        self.symbols = take(symbols, "<u2" if len(payload) - at == 2 * symbols else "<u4").astype(np.int64)

    def _of(self, i: int) -> np.ndarray:
        return self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document alone."""
        return expand(self._of(i), self.rules, self.first_new)

    def id_at(self, i: int, position: int) -> int:
        """One id: find its symbol by expansion lengths, then go down the rules."""
        size = lambda s: np.where(s >= self.first_new, self.lengths[np.maximum(s - self.first_new, 0)] if len(self.lengths) else 1, 1)
        part = self._of(i)
        ends = np.cumsum(size(part))
        at = int(np.searchsorted(ends, position, side="right"))
        symbol, rest = int(part[at]), position - (int(ends[at - 1]) if at else 0)
        while symbol >= self.first_new:
            left, right = map(int, self.rules[symbol - self.first_new])
            n = int(size(np.array(left)))
            symbol, rest = (left, rest) if rest < n else (right, rest - n)
        return symbol

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of all documents, in order."""
        size = np.where(self.symbols >= self.first_new, self.lengths[np.maximum(self.symbols - self.first_new, 0)] if len(self.lengths) else 1, 1)
        stops = np.concatenate([[0], np.cumsum(size)])[self.ends]
        flat, start = expand(self.symbols, self.rules, self.first_new), 0
        for stop in stops.tolist():
            yield flat[start:stop]
            start = stop


# ---- encoding ----------------------------------------------------------------


def _latin(word: bytes) -> bool:
    """Letters of Latin-1 alone."""
    text = word.decode()
    return text.isalpha() and max(text) < "Ā"


class WordIds(dict):
    """Ids of white-space separated words as bytes. The tokenizer drops white space
    and never joins across it, so a text's ids are its words' ids in a row; words come
    again and again, and each goes through the library once while it is kept. It splits
    letters from the marks behind them, so a plain word goes to its merges directly, in
    the characters that stand for bytes, and the marks are a word of their own."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.merges = self.tokenizer.model.tokenize
        # Bytes without a printable Latin-1 character stand 256 further on, in order.
        hidden = [*range(33), *range(127, 161), 173]
        self.byte_chars = {b: 256 + i for i, b in enumerate(hidden)}

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        if len(stem) < len(word) and (stem.isalpha() or _latin(stem)):
            out = self[stem] + self[word[len(stem) :]]
        elif stem.isalpha():
            out = array("I", [t.id for t in self.merges(stem.decode().lower())]).tobytes()
        elif _latin(stem):
            text = stem.decode().lower().encode().decode("latin-1").translate(self.byte_chars)
            out = array("I", [t.id for t in self.merges(text)]).tobytes()
        else:
            out = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        # The tokenizer lower-cases; doing it to A-Z here makes words meet more often,
        # but special strings are matched in their own case.
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        return [b"".join(map(self.__getitem__, (t if b"<|" in t else t.translate(_LOWER)).split())) for t in raw]


@cache
def _word_ids(path: str) -> WordIds:
    """One per worker process, so that what a task has learnt serves the next."""
    return WordIds(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``documents`` and write shard files in ascending doc_id order (nulls
    first; rows with one doc_id in the order of a hash of their texts). Null and empty
    texts have the end id alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    first_new = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end + 1)
    stop = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        part, seq, words = TaskContext.get().partitionId(), 0, _word_ids(vocabulary)
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [held // 4], "doc_ids": [np.array([-1 if k is None else k for k in keys], dtype="<i8").tobytes()], "null_ids": [sum(k is None for k in keys)], "payload": [pack(ids, first_new)]})

        for b in batches:
            known = b["doc_id"].notna().to_numpy()
            for doc, ok, one in zip(b["doc_id"].fillna(0).astype("int64").tolist(), known, words.ids(b["text"].tolist()), strict=True):
                one += stop
                if ids and held + len(one) > 4 * shard_ids:
                    yield row()
                    keys, ids, held, seq = [], [], 0, seq + 1
                keys.append(doc if ok else None)
                ids.append(one)
                held += len(one)
        if ids:
            yield row()

    order = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "part int, seq int, n_docs long, n_ids long, doc_ids binary, null_ids long, payload binary"
    rows.mapInPandas(run, schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in shard files."""
    small_batches(spark, 4)
    shards = spark.read.parquet(path)
    # Two prefix sums, neither over all shards at once: within a part, and over parts.
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("part_start"))
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base, nulls, keys, payload in zip(b["base"], b["null_ids"], b["doc_ids"], b["payload"], strict=True):
                docs = [x.tobytes() for x in Shard(payload).documents()]
                n = np.array([len(x) // 4 for x in docs], dtype=np.int64)
                ids = pd.array(np.frombuffer(keys, dtype="<i8"), dtype="Int64")
                ids[:nulls] = pd.NA  # nulls sort first
                yield pd.DataFrame({"doc_id": ids, "start": base + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array([zlib.crc32(x) for x in docs], dtype=np.int64)})

    # A shard's start is 24 bytes; while they are few the payloads need not move.
    starts = F.broadcast(starts) if shards.count() <= SENT else starts
    whole = shards.select("part", "seq", "null_ids", "doc_ids", "payload").join(starts, ["part", "seq"])
    return whole.select("base", "null_ids", "doc_ids", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)


QUERIES = {"op3_token_ids": op3_token_ids}
ORACLES: dict[str, str] = {}
