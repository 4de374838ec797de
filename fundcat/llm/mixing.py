"""Mixing to target weights by soft membership.

A Gaussian classifier, fitted on the labelled documents, gives every document its
posterior of each domain. Document rates are then the nonnegative least-squares fit of
the expected tokens per domain to the targets, by projected gradient: each step needs
one sum over the documents, and a rate is a fold over the steps so far, so the state
between steps is a few numbers and nothing is rewritten.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import cut, settled, table

#: Domains of the labelled table (the quality mark) and their shares of the tokens.
TARGETS: dict[str, float] = {"high": 0.98, "low": 0.02}
#: Distance from the targets, as a share of all tokens, at which the fit is done, and
#: steps without a gain of a hundredth after which it gives up, with a warning.
CLOSE, PATIENCE = 1e-6, 10
#: Least variance of a feature within a domain.
FLOOR = 1e-3
FEATURES = ("ln(1 + tokens)", "ln(1 + chars / greatest(tokens, 1))", "ln(1 + 100 * marks / greatest(chars, 1))", "ln(1 + 100 * uppers / greatest(chars, 1))")


def features(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, tokens, luck, x0..)``: whole-text counts, words being the tokens, a hash
    of id and text from 0 to 1, and the columns ``carried``. Null and empty texts have
    no words."""
    text = F.coalesce("text", F.lit(""))
    counts = docs.select(
        *carried, F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit("mix")), F.lit(1_000_000)) / 1_000_000).alias("luck"),
        F.length(text).alias("chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>!]")).alias("marks"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("uppers"),
    )
    return counts.select(*carried, "doc_id", "tokens", "luck", *[F.expr(f).alias(f"x{i}") for i, f in enumerate(FEATURES)])


def classifier(rows: DataFrame, labelled: DataFrame, domains: list[str]) -> list[tuple[float, list[float], list[float]]]:
    """Log weight, means and variances of each domain from ``features`` rows. ``labelled``
    is ``(doc_id, domain)``; ids with more than one domain, unknown domains and nulls
    teach nothing. A domain without rows has the spread of all and one row's weight."""
    d = range(len(FEATURES))
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other")
    taught = rows.join(known.select("doc_id", "domain"), "doc_id")
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in d] + [F.sum(F.col(f"x{i}") ** 2).alias(f"q{i}") for i in d]
    found = {r["domain"]: r for r in taught.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}  # one row per domain
    total = sum(r["n"] for r in found.values())
    model = []
    for name in domains:
        of = [found[name]] if name in found else list(found.values())
        n = sum(r["n"] for r in of)
        weight = (found[name]["n"] if name in found else 0) + 1
        means = [sum(r[f"s{i}"] for r in of) / n for i in d] if n else []
        variances = [max(FLOOR, sum(r[f"q{i}"] for r in of) / n - means[i] ** 2) for i in d] if n else []
        model.append((math.log(weight / (total + len(domains))), means, variances))
    return model


def posteriors(rows: DataFrame, model: list[tuple[float, list[float], list[float]]]) -> DataFrame:
    """``features`` rows, and whatever they carry, with ``p0..``, the posterior of each
    domain, in place of the features."""
    logs = []
    for weight, means, variances in model:
        log = F.lit(weight)
        for i, (mean, var) in enumerate(zip(means, variances, strict=True)):
            log = log - F.pow(F.col(f"x{i}") - mean, 2) / (2 * var) - math.log(var) / 2
        logs.append(log)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    kept = [c for c in rows.columns if c not in {f"x{i}" for i in range(len(FEATURES))}]
    rows = rows.select(*kept, *[F.exp(x - top).alias(f"e{k}") for k, x in enumerate(logs)])
    whole = sum((F.col(f"e{k}") for k in range(1, len(logs))), F.col("e0"))
    return rows.select(*kept, *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(logs))])


def _inverse(a: list[list[float]]) -> list[list[float]]:
    import numpy as np

    m = np.array(a)
    return np.linalg.inv(m + 1e-9 * max(1e-12, float(np.trace(m))) * np.eye(len(m))).tolist()


def fit_rates(members: DataFrame, targets: dict[str, float]) -> list[list[float]]:
    """The steps of the fit, from rate 1, over ``posteriors`` rows. They are scaled by the
    documents' tokens and by the Gram matrix of the domains over the documents whose rate
    is above zero, so that a rate depends on a document's domains and not on its length,
    and few steps are needed. Every step is one sum over the documents."""
    k = len(targets)
    want = [w / sum(targets.values()) for w in targets.values()]
    moves: list[list[float]] = []
    least, since = float("inf"), 0
    while True:
        now = members.select("tokens", *[f"p{i}" for i in range(k)], rate(moves, k).alias("rate"))
        sums = [F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{i}")).alias(f"h{i}") for i in range(k)]
        gram = [F.sum(F.when(F.col("rate") > 0, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}"))).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
        have = now.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), *sums, *gram).first()
        total = float(have["tokens"])
        if not total:
            return []
        off = [have[f"h{i}"] / total - want[i] for i in range(k)]
        worst = max(map(abs, off))
        least, since = (worst, 0) if worst < 0.99 * least else (least, since + 1)
        if worst < CLOSE:
            return moves
        if since == PATIENCE:
            warnings.warn(f"mixing stopped {worst:.2g} of all tokens from its targets", stacklevel=2)
            return moves
        inverse = _inverse([[(have[f"g{i}_{j}"] or 0.0) / total for j in range(k)] for i in range(k)])
        moves.append([sum(inverse[i][j] * off[j] for j in range(k)) for i in range(k)])


def rate(moves: list[list[float]], k: int) -> F.Column:
    """The rate of a row with ``p0..`` after the steps: never below zero."""
    if not moves:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(x) for x in m]) for m in moves])
    pull = lambda m: sum((F.get(m, i) * F.col(f"p{i}") for i in range(1, k)), F.get(m, 0) * F.col("p0"))
    return F.aggregate(taken, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r - pull(m)))


def _copies(rate_: F.Column) -> F.Column:
    return (F.floor(rate_) + (F.col("luck") < rate_ - F.floor(rate_)).cast("long")).cast("int")


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: ``high`` and ``low`` by the quality mark."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def _fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, list, list[list[float]]]:
    rows = cut(features(docs), "counts")
    model = classifier(rows, labelled, list(targets))
    members = cut(posteriors(rows, model), "posteriors")
    return members, model, fit_rates(members, targets)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``documents`` -> ``(doc_id, tokens, p_<domain>.., rate, copies)``, one row per
    input row. ``copies`` is the rate rounded up or down by a hash of id and text, so that
    the expected copies are the rate. With no labels posteriors are even; an empty
    table gives an empty result; a null doc_id is carried through; other columns are
    ignored."""
    targets = targets or TARGETS
    members, _, moves = _fitted(docs, labelled, targets)
    named = [F.col(f"p{i}").alias(f"p_{name}") for i, name in enumerate(targets)]
    rows = members.select("doc_id", "tokens", "luck", *named, rate(moves, len(targets)).alias("rate"))
    return rows.withColumn("copies", _copies(F.col("rate"))).drop("luck")


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``documents`` with every row as often as its copies say. Columns are unchanged,
    whatever their names. Copies are an expression of the row, so texts stay where they
    are; null and repeated doc_ids and rows that repeat are decided one by one; an empty
    table gives an empty result."""
    targets = targets or TARGETS
    _, model, moves = _fitted(docs, labelled, targets)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = settled(posteriors(settled(features(docs.select(row, "doc_id", "text"), ("row",))), model))
    rows = settled(rows.select("row", "luck", rate(moves, len(targets)).alias("rate"))).select("row", _copies(F.col("rate")).alias("copies"))
    rows = settled(rows).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
