"""Token counts by byte-pair merging over a heap and a linked list.

Each merge takes one symbol away, so a piece's count is its symbols less its merges
and no id is ever made. Pieces come again and again; their counts are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import small_batches, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Distinct pieces whose counts a worker keeps.
CACHE = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def count_merged(symbols: list, ranks: dict) -> int:
    """Symbols left when the adjacent pair of the lowest rank, the leftmost of equals,
    has been merged again and again. ``ranks``: (left, right) -> (rank, merged)."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b)))]
    heapify(heap)
    count = n
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i] = merged = ranks[a, b][1]
        symbols[j] = None
        right[i] = k = right[j]
        right[j] = -1
        count -= 1
        if k >= 0:
            left[k] = i
            if r := ranks.get((merged, symbols[k])):
                heappush(heap, (r[0], i, merged, symbols[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], merged))):
            heappush(heap, (r[0], h, symbols[h], merged))
    return count


class PieceCounts(dict):
    """Tokens of a piece of text between the vocabulary's splits."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.symbol = [ids[c] for c in byte_symbols()]
        special = [t["content"] for t in file["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        symbol = self.symbol
        n = self[piece] = count_merged([symbol[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks)
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts if p)


@cache
def _piece_counts(path: str, pattern: str) -> PieceCounts:
    """One per worker process, so that what a task has learnt serves the next."""
    return PieceCounts(path, pattern)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``documents`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input
    row. Null and empty texts have 0 bytes and 0 tokens; special strings in a text
    count one each; repeated rows keep their repeats; other columns are ignored."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    path, pattern = vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _piece_counts(path, pattern)
        for b in batches:
            n = np.array([counts.of(t) for t in b["text"]], dtype=np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, "text")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
