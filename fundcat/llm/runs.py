"""Periodic runs of words, found in a grammar of the documents.

The word ids of a group of documents are Re-Pair compressed together, and what is left of
each document is paired up evenly, so that every document is a tree of symbols with two
parts each. A run lies in the smallest symbol that holds it and crosses the border of that
symbol's parts. So the runs that cross its border are looked for once for each symbol, in
one of the places that it stands for, and are then carried to all of its places; where a
symbol's edge cuts a run off, a larger symbol has the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import WORD, table
from fundcat.llm.repair import compress, layers, lengths

#: The least length of a run, in words and in periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that share a grammar; a longer document has one of its own.
GROUP_WORDS = 200_000
#: Rules that a round of Re-Pair adds, and periods that are looked at together.
ROUND_RULES, TOGETHER = 16_384, 1 << 21
#: Words compared on either side before stretches get names.
LOOK = 8
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Substrings:
    """Names of all substrings of lengths 1, 2, 4, ...: equal ones have equal names."""

    def __init__(self, flat: np.ndarray) -> None:
        self.names = [flat.astype(np.int64)]

    def _grow(self, longest: int) -> None:
        while 1 << len(self.names) <= longest:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= half:
                break
            key = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.names.append(pd.factorize(key)[0].astype(np.int64))

    def ahead(self, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words that are equal from ``i`` and from ``j`` > i on, before ``stop``."""
        i, j = i.copy(), j.copy()
        begin = j.copy()
        self._grow(int((stop - j).max(initial=0)))
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            at = np.flatnonzero(j + size <= stop)
            at = at[names[i[at]] == names[j[at]]]
            i[at] += size
            j[at] += size
        return j - begin

    def behind(self, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words that are equal up to ``i`` and up to ``j`` > i, from ``stop`` on."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        self._grow(int((i - stop).max(initial=0)))
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            at = np.flatnonzero(i - size >= stop)
            at = at[names[i[at] - size] == names[j[at] - size]]
            i[at] -= size
            j[at] -= size
        return begin - i


def _survivors(flat: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Periods that may have a run across ``mid``: (which, period, i, j), the words at i
    and j being equal and one period apart. A run that crosses a border reaches a whole
    period to its left or three to its right, so the words one period before and after
    the border are compared with those at it, and then a few around them."""
    most = (hi - lo) // MIN_PERIODS
    for reach, back in ((np.minimum(most, mid - lo), True), (np.minimum(most, hi - 1 - mid), False)):
        ends = np.cumsum(reach)
        start = 0
        while start < len(reach):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
            part = reach[start:stop]
            of = np.repeat(np.arange(start, stop), part)
            q = np.arange(len(of)) - np.repeat(np.cumsum(part) - part, part) + 1
            i = mid[of] - q if back else mid[of]
            same = flat[i] == flat[i + q]
            of, q, i = of[same], q[same], i[same]
            ahead, behind = np.ones(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
            for d in range(1, LOOK + 1):
                at = np.flatnonzero((ahead == d) & (i + q + d < hi[of]))
                ahead[at[flat[i[at] + d] == flat[i[at] + q[at] + d]]] += 1
                at = np.flatnonzero((behind == d - 1) & (i - d >= lo[of]))
                behind[at[flat[i[at] - d] == flat[i[at] + q[at] - d]]] += 1
            may = (ahead > LOOK) | (behind == LOOK) | (ahead + behind >= _needed(q))
            of, q, i = of[may], q[may], i[may]
            yield of, q, i, i + q
            start = stop


def _needed(q: np.ndarray) -> np.ndarray:
    """A run is equal to itself a period on for its length but one period."""
    return np.maximum((MIN_PERIODS - 1) * q, MIN_WORDS - q)


def _crossing(flat: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs within [lo, hi) that cross ``mid``: (which, start, end, period)."""
    found = [(lo[:0],) * 4, *_survivors(flat, lo, mid, hi)]
    of, q, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    # Longer stretches are compared by names, of the words that any of them may reach.
    near = np.zeros(len(flat) + 1, dtype=np.int64)
    items = np.unique(of)
    np.add.at(near, lo[items], 1)
    np.add.at(near, hi[items], -1)
    near = np.cumsum(near[:-1]) > 0
    words, at = Substrings(flat[near]), np.cumsum(near) - near
    ahead = words.ahead(at[i], at[j], at[hi[of] - 1] + 1)
    behind = words.behind(at[i], at[j], at[lo[of]])
    s, e = i - behind, j + ahead
    ok = (ahead + behind >= _needed(q)) & (s < mid[of]) & (e > mid[of])
    of, s, e, q = of[ok], s[ok], e[ok], q[ok]
    # Of periods of one stretch the smallest divides the others.
    order = np.lexsort((q, e, s, of))
    of, s, e, q = of[order], s[order], e[order], q[order]
    first = np.ones(len(of), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return of[first], s[first], e[first], q[first]


def _halves(at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair up the neighbours of each document until it is one symbol: (lo, mid, hi)."""
    out = [(at[:0],) * 3]
    while len(doc) > 1 and (doc[1:] == doc[:-1]).any():
        new = np.ones(len(doc), dtype=bool)
        new[1:] = doc[1:] != doc[:-1]
        place = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        out.append((at[left], at[left + 1], at[left + 1] + size[left + 1]))
        size = size.copy()
        size[left] += size[left + 1]
        keep = place % 2 == 0
        at, size, doc = at[keep], size[keep], doc[keep]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _whole(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of each period, and the smallest period of each stretch. Two
    stretches of one period that share that many words are one."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    if len(s):
        # Ends so far within a period: periods are set apart by more than any position.
        apart = np.unique(q, return_inverse=True)[1] * (int(e.max()) + 1)
        reach = np.maximum.accumulate(e + apart)
        new = np.ones(len(s), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (s[1:] + apart[1:] + q[1:] > reach[:-1])
        at = np.flatnonzero(new)
        s, q, e = s[at], q[at], np.maximum.reduceat(e, at)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[first], e[first], q[first]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def group_runs(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of documents whose word ids lie in a row, in order of
    start and period. ``sizes`` are the documents' words."""
    stops = np.cumsum(sizes)
    if not len(flat):
        return (np.zeros(0, dtype=np.int64),) * 3
    last = np.zeros(len(flat), dtype=bool)
    last[stops[sizes > 0] - 1] = True
    top = int(flat.max()) + 1
    # Any pair that occurs twice gets a rule; each round shortens the text.
    seq, _, rules = compress(flat, last, top, least=2, pays=1, most=ROUND_RULES)
    seq, of = seq.astype(np.int64), lengths(rules, top)
    steps = list(layers(rules, top))
    size = np.where(seq >= top, of[np.maximum(seq - top, 0)] if len(of) else 1, 1)
    at = np.cumsum(size) - size
    # One place of each rule's symbol: in the texts, or in a rule that has one.
    place = np.full(len(rules), -1, dtype=np.int64)
    inner = seq >= top
    place[seq[inner] - top] = at[inner]
    left_size = np.where(rules[:, 0] >= top, of[np.maximum(rules[:, 0] - top, 0)], 1) if len(rules) else of
    for begin, end in reversed(steps):
        for side, shift in ((0, 0), (1, left_size[begin:end])):
            child, where = rules[begin:end, side], place[begin:end] + shift
            inner = child >= top
            place[child[inner] - top] = where[inner]
    lo, mid, hi = _halves(at, size, np.searchsorted(stops, at, side="right"))
    wide = of >= MIN_WORDS
    which = np.flatnonzero(wide)
    n_tops = len(lo)
    lo = np.concatenate([lo, place[which]])
    mid = np.concatenate([mid, (place + left_size)[which]])
    hi = np.concatenate([hi, (place + of)[which]])
    item, s, e, q = _crossing(flat, lo, mid, hi)
    tops = item < n_tops
    found = [(s[tops], e[tops], q[tops])]
    # Carry the others from the texts down, through symbols that hold a run alone.
    rule = which[item[~tops] - n_tops]
    s, e, q = s[~tops] - place[rule], e[~tops] - place[rule], q[~tops]
    order = np.argsort(rule, kind="stable")
    rule, s, e, q = rule[order], s[order], e[order], q[order]
    bears = np.zeros(len(rules) + 1, dtype=bool)  # the last stands for single words
    bears[rule] = True
    child = np.where(rules >= top, rules - top, len(rules))
    for begin, end in steps:
        bears[begin:end] |= bears[child[begin:end]].any(axis=1)
    inner = np.flatnonzero(seq >= top)
    symbol, where = seq[inner] - top, at[inner]
    while len(symbol):
        keep = bears[symbol]
        symbol, where = symbol[keep], where[keep]
        a, b = np.searchsorted(rule, symbol), np.searchsorted(rule, symbol, side="right")
        n = b - a
        own = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        shift = np.repeat(where, n)
        found.append((s[own] + shift, e[own] + shift, q[own]))
        both, where = child[symbol], np.stack([where, where + left_size[symbol]], axis=1)
        inner = both < len(rules)
        symbol, where = both[inner], where[inner]
    return _whole(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _groups(texts: Iterator[tuple[int | None, bytes]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Documents' words, gathered until a group is full."""
    group, held = [], 0
    for key, text in texts:
        words = text.split()  # bytes are split at space and \t..\r alone
        if group and held + len(words) > GROUP_WORDS:
            yield group
            group, held = [], 0
        group.append((key, words))
        held += len(words)
    if group:
        yield group


def _rows(group: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for _, words in group for w in words], dtype=np.int64)
    sizes = np.array([len(words) for _, words in group], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    s, e, q = group_runs(flat, sizes)
    # Words behind a run's first period: +1 where they begin, -1 where they end.
    depth = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(depth, s + q, 1)
    np.add.at(depth, e, -1)
    kept = np.cumsum(depth[:-1]) == 0
    cuts = np.searchsorted(s, np.append(starts, len(flat)))
    collapsed = []
    for (_, words), start, a, b in zip(group, starts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            words = [w for w, k in zip(words, kept[start : start + len(words)].tolist(), strict=True) if k]
        collapsed.append(b" ".join(words))
    base = np.repeat(starts, np.diff(cuts))
    struct = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in group], pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row per input row, without a shuffle. A
    run is a stretch of words that repeats with its smallest period, at least four times
    and six words long, and that no neighbour extends; runs stand in order of start and
    period. ``collapsed`` joins by one space the words that are not behind the first
    period of any run.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows
    that repeat have results of their own, other columns are ignored, long texts are held
    whole, and an empty table gives an empty result. Runs do not hang on which documents
    share a grammar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            if pa.types.is_string(texts.type):
                texts = texts.cast(pa.binary())
            yield from map(_rows, _groups(zip(b.column("doc_id").to_pylist(), (t.as_py() or b"" for t in texts), strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def plant(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a periodic tail in a tenth of the documents, those whose
    crc32 of the decimal doc_id ends in 0: with g a tenth of it and n words, every word
    i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Texts
    without words and rows without a doc_id stay as they are."""
    h = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), "w", F.size("w").cast("long").alias("n"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    rows = rows.select("*", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    moved = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = find_runs(plant(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.select("doc_id", "runs", best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
