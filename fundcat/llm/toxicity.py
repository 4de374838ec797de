"""Toxicity by a counterfactually regularised classifier.

Logistic regression over the words, and beginnings of words, that a document holds. For each labelled document
with an identity term a counterpart is made with the term swapped for another of its
family, and the squared change of the score (as a logit) is penalised, so that naming
a group does not move a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import small_batches, table

THRESHOLD = 0.7
#: Labelled rows that the classifier is fitted on at most, and words that it knows.
MAX_ROWS, MAX_WORDS = 20_000, 8_192
#: Least log-likelihood ratio of a word and the label; by chance alone few words of a
#: large vocabulary reach it.
EVIDENCE = 20.0
STEPS, RATE, RIDGE, SWAP = 400, 0.1, 2e-5, 1.0

#: Families of identity terms; terms of a family may take each other's place.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("woman", "man"),
    ("women", "men"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("musulman", "chrétien", "juif"),
    ("femme", "homme"),
    ("moslem", "christ", "jude"),
    ("frau", "mann"),
    ("musulmán", "cristiano", "judío"),
    ("mujer", "hombre"),
)

_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features too; they bear inflected words.
STEMS = (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and the beginnings of longer ones, marked by a dash."""
    return _stemmed(set(_WORD.findall(text.lower())) if text else set())


def _stemmed(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias + sum(sorted(w[x] for x in words_of(text) & w.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def swaps(words: set[str], families=IDENTITY) -> set[str] | None:
    """The words with each identity term swapped for the next of its family that is
    not there; None if there is no such term."""
    out, hit = {w for w in words if not w.endswith("-")}, False
    for family in families:
        for k, term in enumerate(family):
            if term in words:
                other = next((family[(k + d) % len(family)] for d in range(1, len(family)) if family[(k + d) % len(family)] not in words), None)
                if other:
                    out.discard(term)
                    out.add(other)
                    hit = True
    return _stemmed(out) if hit else None


def fit(features: list[list[int]], labels: np.ndarray, counterparts: list[tuple[int, list[int]]], n_words: int, swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam. Both classes weigh the same.
    ``counterparts``: (row, features with terms swapped)."""
    size = np.array([len(f) for f in features], dtype=np.int64)
    row, col = np.repeat(np.arange(len(features)), size), np.array([c for f in features for c in f], dtype=np.int64)
    of = np.array([r for r, _ in counterparts], dtype=np.int64)
    # A counterpart minus its original, as (pair, word, +1 or -1).
    changes = [(k, c, s) for k, (r, f) in enumerate(counterparts) for s, cs in ((1.0, set(f) - set(features[r])), (-1.0, set(features[r]) - set(f))) for c in cs]
    pair, word, sign = (np.array([x[i] for x in changes], dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    y = labels.astype(np.float64)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(n_words), 0.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, STEPS + 1):
        z = b + np.bincount(row, weights=w[col], minlength=len(y))
        err = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(col, weights=err[row], minlength=n_words) + RIDGE * w
        if len(changes):
            moved = np.bincount(pair, weights=sign * w[word], minlength=len(of))
            g += 2 * swap / len(of) * np.bincount(word, weights=sign * moved[pair], minlength=n_words)
        g = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, families=IDENTITY, swap: float = SWAP) -> Classifier:
    """Fit on labelled rows outside the held-out third. Beyond ``max_rows`` a share of
    them is taken by a hash of the id. An id whose labels conflict counts as toxic; of an id
    that several documents have, one text is learnt from, so what is collected is bounded
    by ids and rows alike. Words are chosen by the log-likelihood
    ratio of word and label; counting them is a Spark job, and what reaches the driver is bounded by
    ``max_rows`` and ``max_words``."""
    spark = docs.sparkSession
    small_batches(spark)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    given = given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = given.count()
    if n > max_rows:
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(950_000 * max_rows / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(given), "doc_id")  # max_rows ids at most, about
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r")).select("doc_id", "r.text", "r.toxic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "words": [sorted(words_of(t)) for t in b["text"]]})

    from fundcat.llm.common import cut

    held = cut(rows.mapInPandas(run, "doc_id long, toxic int, words array<string>"), "labelled")
    totals = dict(held.groupBy("toxic").count().collect())
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Classifier({}, 0.0 if not pos + neg else 60.0 if pos else -60.0)
    counts = held.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    evidence = 2 * (part(F.col("k"), pos / (pos + neg)) + part(F.col("n") - F.col("k"), neg / (pos + neg)))
    terms = [t for f in families for t in f]
    best = counts.withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "word").limit(max_words).select("word")
    chosen = [r[0] for r in best.unionByName(counts.where(F.col("word").isin(terms)).select("word")).distinct().orderBy("word").collect()]
    known = {w: i for i, w in enumerate(sorted({*chosen, *terms}))}
    sent = spark.sparkContext.broadcast(known)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = sent.value
        for b in batches:
            out = []
            for ws in b["words"]:
                ws = set(ws)
                other = swaps(ws, families)
                out.append((sorted(at[w] for w in ws & at.keys()), other is not None, sorted(at[w] for w in other & at.keys()) if other else []))
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "at": [x[0] for x in out], "swapped": [x[1] for x in out], "other": [x[2] for x in out]})

    sample = held.mapInPandas(index, "doc_id long, toxic int, at array<int>, swapped boolean, other array<int>").toPandas().sort_values("doc_id")
    features = [list(map(int, x)) for x in sample["at"]]
    pairs = [(k, list(map(int, o))) for k, (s, o) in enumerate(zip(sample["swapped"], sample["other"], strict=True)) if s]
    w, b = fit(features, sample["toxic"].to_numpy(), pairs, len(known), swap)
    return Classifier({word: float(w[i]) for word, i in known.items() if abs(w[i]) > 1e-6}, b)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``documents`` -> ``(doc_id, held_out, score, predicted)``, one row per input
    row; null and empty texts get the score of no words, a null doc_id is carried
    through and not held out. Repeated rows keep their repeats, other columns are ignored,
    an empty table gives an empty result; a score of exactly the threshold is predicted."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in text], dtype="float64")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those predicted toxic. Columns are unchanged, whatever their
    names; null and empty texts get the score of no words; rows are judged one by one, so
    null and repeated doc_ids and rows that repeat make no difference; an empty table gives
    an empty result."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) < THRESHOLD for t in text], dtype="bool")

    return docs.where(clean("text"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
