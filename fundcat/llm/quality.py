"""Quality rules: hard limits, then robust multivariate outliers.

Each document has a vector of transformed statistics. For every language and source a
minimum-covariance-determinant estimate is found by concentration steps: distances
under the present mean and covariance, the share ``H`` of the rows with the smallest,
their mean and covariance, and so on, from two starts (the medians, and the mean and
covariance of all rows) until the determinant falls no more; the start that ends with
the smaller one counts. Rows whose robust Mahalanobis distance passes a chi-squared
limit are rejected. All of it is DataFrame work: the covariances are
sums, the factorisation is column arithmetic on one row per group, and the quantiles
come from counts of rounded distances, so no group is ever gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundcat.llm.common import cut, settled, table

SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Share of a group's rows that an estimate rests on, and the least fall of the
#: determinant's logarithm for which another step is made.
H, FALL = 0.75, 0.01
#: Groups with fewer rows use the estimate of all their language's rows, then that of all
#: rows; the column ``estimate`` tells which (2, 1, 0).
MIN_GROUP = 60
#: Groups and estimates that are sent to all tasks; more are joined.
SENT = 100_000
#: Chance that a clean Gaussian row is rejected.
ALPHA = 1e-6
#: Transformed statistics and the standard deviation that is added to that of each: in
#: most groups nearly every row has no symbols and no repeats, and its spread would be nil.
FEATURES: tuple[tuple[str, str, float], ...] = (
    ("f_words", "ln(n_words)", 0.5),
    ("f_length", "ln(word_chars / n_words)", 0.05),
    ("f_symbols", "ln(1 + 100 * n_symbols / word_chars)", 0.25),
    ("f_lines", "ln(1 + 100 * n_dup_lines / n_words)", 0.3),
    ("f_repeats", "n_repeat_words / n_words", 0.1),
)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def statistics(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed)`` of whole texts, one row per input row, and the columns
    ``carried``. Null and empty texts have no words. A window of eight words counts by
    its 64-bit hash."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *carried, F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *carried, "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))).alias("windows"),
    )
    # Few texts repeat a window: the others are settled by a count of distinct hashes.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    again = F.filter("ordered", lambda x, k: x["h"].eqNullSafe(F.get("ordered", k - 1)["h"]) | x["h"].eqNullSafe(F.get("ordered", k + 1)["h"]))
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    gaps = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))).cast("long"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select(*carried, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _groups(vectors: DataFrame) -> DataFrame:
    """``(lang, source, cell, fits)``: the estimate that judges a group's rows, which is
    its own, or a wider one where there are too few rows, and the estimates that they take
    part in. A wider estimate rests on every row of its language, or on all rows, those of
    large groups too; it is made only where a small group uses it."""
    sizes = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    wide = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("n_least"))
    least = wide.agg(F.min("n_lang").alias("n_lang_least"))
    own, language = F.concat(F.lit("2"), F.to_json(F.array("lang", "source"))), F.concat(F.lit("1"), F.to_json(F.array("lang")))
    large, large_lang = F.col("n") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    fits = F.array(F.when(large, own), F.when(large_lang & (F.col("n_least") < MIN_GROUP), language), F.when(F.col("n_lang_least") < MIN_GROUP, F.lit("0")))
    cell = F.when(large, own).when(large_lang, language).otherwise("0")
    return sizes.join(wide, "lang").crossJoin(F.broadcast(least)).select("lang", "source", cell.alias("cell"), F.array_compact(fits).alias("fits"))


def _small(df: DataFrame) -> DataFrame:
    """With a hint to send it to all tasks if it has few rows."""
    return F.broadcast(df) if df.count() <= SENT else df


def _quantile(rows: DataFrame, bucket, share: float, name: str) -> DataFrame:
    """Per cell, the smallest bucket that ``share`` of its rows do not pass."""
    counts = rows.groupBy("cell", bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("cell").orderBy("bucket")
    of = Window.partitionBy("cell")
    return counts.select("cell", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(of).alias("all")).where(F.col("upto") >= F.col("all") * share).groupBy("cell").agg(F.min("bucket").alias(name))


def _names() -> list[str]:
    return [f for f, _, _ in FEATURES]


def _cholesky(m: DataFrame, factor: float) -> DataFrame:
    """Mean, Cholesky factor and log determinant of each cell's covariance from its sums."""
    d = len(FEATURES)
    m = m.select("cell", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(d)], "n", *[f"s{i}_{j}" for i in range(d) for j in range(i + 1)])
    for i in range(d):
        for j in range(i + 1):
            c = factor * (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + FEATURES[i][2] ** 2
            for k in range(j):
                c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            m = m.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}_{j}"))
    size = sum((F.ln(f"l{i}_{i}") for i in range(1, d)), F.ln("l0_0"))
    return m.select("cell", *_PARAMETERS, (2 * size).alias("size"))


#: Columns of an estimate: means and the Cholesky factor.
_PARAMETERS = [f"m{i}" for i in range(len(FEATURES))] + [f"l{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1)]


def _sums(rows: DataFrame) -> DataFrame:
    names, d = _names(), len(FEATURES)
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(d) for j in range(i + 1)])


def _distances(vectors: DataFrame, model: DataFrame) -> DataFrame:
    rows = vectors.join(model.select("cell", *_PARAMETERS), "cell")
    for i, n in enumerate(_names()):
        z = F.col(n) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}_{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(FEATURES))), F.col("z0") * F.col("z0"))
    return rows.select(*vectors.columns, total.alias("d2"))


def _core(rows: DataFrame) -> DataFrame:
    """The share ``H`` of each cell with the smallest distances, to within one bucket
    of a hundredth of ln d2."""
    bucket = F.floor(F.ln(F.col("d2") + 1e-9) * 100)
    limit = _quantile(rows, bucket, H, "most")
    return rows.join(limit, "cell").where(bucket <= F.col("most"))


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(e).cast("double").alias(n) for n, e, _ in FEATURES])


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``statistics`` rows -> the groups ``(lang, source, cell)`` and the estimates
    ``(cell, m.., l..)`` of those that did not fail, each a row per group."""
    d = len(FEATURES)
    factor = H / chi2_cdf(chi2_quantile(H, d), d + 2)
    vectors = cut(_vectors(stats.where("not base_failed")).select("lang", "source", *_names()), "vectors")
    groups = cut(_groups(vectors), "groups")
    # Each cell is fitted from both starts at once: "a" the medians, "b" mean and covariance.
    fitted = vectors.join(_small(groups).drop("cell"), ["lang", "source"]).select(F.explode("fits").alias("cell"), *_names())
    fitted = cut(fitted.select(F.explode(F.array(F.concat(F.lit("a"), "cell"), F.concat(F.lit("b"), "cell"))).alias("cell"), *_names()), "fitted")
    medians = None
    for i, n in enumerate(_names()):
        part = _quantile(fitted.where("cell like 'a%'"), F.round(F.col(n) * 1000), 0.5, f"q{i}")
        medians = part if medians is None else medians.join(part, "cell")
    flat = [F.lit(FEATURES[i][2] if i == j else 0.0).alias(f"l{i}_{j}") for i in range(d) for j in range(i + 1)]
    medians = medians.select("cell", *[(F.col(f"q{i}") / 1000).alias(f"m{i}") for i in range(d)], *flat)
    whole = _cholesky(_sums(fitted.where("cell like 'b%'")), 1.0).select("cell", *_PARAMETERS)
    ends = _concentrate(fitted, cut(medians.unionByName(whole), "start"), factor)
    best = ends.groupBy(F.expr("substring(cell, 2)").alias("cell")).agg(F.min(F.struct("size", *_PARAMETERS)).alias("best")).select("cell", "best.*")
    return groups.select("lang", "source", "cell"), cut(best, "estimates")


def _concentrate(fitted: DataFrame, model: DataFrame, factor: float) -> DataFrame:
    """Steps until no cell's determinant falls any further; cells that are done sit out.
    Every step lowers an open cell's log determinant by ``FALL``, and the spread that is
    added bounds it from below, so the steps end."""
    model = cut(_cholesky(_sums(_core(_distances(fitted, model))), factor), "mcd")
    done = None
    while True:
        nxt = _cholesky(_sums(_core(_distances(fitted, model))), factor)
        old = model.select(F.col("cell").alias("old_cell"), F.col("size").alias("old_size"))
        nxt = cut(nxt.join(old, nxt["cell"] == old["old_cell"]).drop("old_cell"), "mcd")
        falls = nxt.where(F.col("size") < F.col("old_size") - FALL).drop("old_size")
        over = model.join(falls.select("cell"), "cell", "left_anti")
        done = over if done is None else done.unionByName(over)
        if falls.isEmpty():
            return done
        model = falls


def score(rows: DataFrame, groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """``statistics`` rows that did not fail, whatever other columns they have, with
    ``cell`` and ``d2``, the squared robust Mahalanobis distance. Groups and estimates are
    sent to the rows, which stay where they are, unless there are very many."""
    return _distances(_vectors(rows.where("not base_failed")).join(_small(groups), ["lang", "source"]), _small(estimates)).drop(*_names())


def robust_distances(stats: DataFrame) -> DataFrame:
    """``statistics`` rows that did not fail, with ``d2`` under estimates of the same rows."""
    return score(stats, *fit(stats))


def judge(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``documents`` -> statistics, ``base_failed``, ``kept`` and ``estimate`` of every row.

    A null doc_id, language or source is a value of its own; repeated rows keep their
    repeats; an empty table gives an empty result; other columns are ignored."""
    stats = cut(statistics(docs), "statistics")
    limit = chi2_quantile(1 - alpha, len(FEATURES))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = score(stats, *fit(stats)).select(*out, (F.col("d2") <= limit).alias("kept"), F.substring("cell", 1, 1).cast("int").alias("estimate"))
    return passed.unionByName(stats.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("int").alias("estimate")))


def reject(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``documents`` without the rows that fail, each judged by itself: null or repeated
    doc_ids, and rows that repeat, make no difference. Null and empty texts fail, an empty
    table gives an empty result, columns are unchanged, whatever their names. Rows are
    written once beside their statistics and filtered where they are."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[(F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("doc_id", "text", "lang", "source")])
    stats = cut(statistics(held, ("row",)), "statistics")
    limit = chi2_quantile(1 - alpha, len(FEATURES))
    judged = score(stats, *fit(stats.drop("row"))).select("row", (F.col("d2") <= limit).alias("kept"))
    return settled(judged).where("kept").select("row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
