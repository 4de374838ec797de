"""Nearest neighbours by an inverted file of product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every distinct vector is
assigned to a centroid's list and its residual is coded. A query goes to the blocks that
hold the lists nearest to it, and those of its nearest among the sample and the longest
vectors, and scores the codes of these lists, and no others, from its distance tables. All
whose code, by its error, leaves it open that they are among the nearest are ranked again
on the original vectors in double precision. Copies of a vector are searched once and brought back at the end: of
equal vectors only the ``k + 1`` smallest ids can be among the ``k`` nearest of any query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundcat.llm.common import cut, small_batches, table

K = 20
#: Vectors that the index is fitted on at most, and lists that it has at most.
SAMPLE, MAX_LISTS = 20_000, 4_096
#: Components of a residual that share a code, and values of a code.
PART, CODES = 4, 256
#: Recall of the probed lists that the number of probes is set for, on the sample.
PROBE_RECALL = 0.99
#: Codes in a block, queries that meet a block in one task, queries scored at once in it,
#: and candidates of a query that are ranked again in any case.
VECTORS, QUERIES_AT_ONCE, CHUNK, AGAIN = 65_536, 4_096, 64, 100
#: Longest vectors that every query is compared with, queries that the probes are set for,
#: and standard deviations of a code's error that count as open.
LONGEST, ASKED, SIGMAS = 2_048, 512, 3.0
#: 128 bits of hash: what tells one vector from another.
PRINT = ("print1", "print2")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(at, weights=x[:, d], minlength=len(c))
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int
    known: np.ndarray
    known_lists: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.stack([_nearest(rest[:, m * PART : (m + 1) * PART], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[lists] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def probed(self, q: np.ndarray, k: int = K) -> list[tuple[np.ndarray, float]]:
        """Lists that each query probes, and a score that its ``k + 1`` nearest reach: lists
        of the centroids with which it has the largest inner products and those of its
        nearest among the known vectors, which also give the score."""
        out, length = [], np.sqrt((self.known * self.known).sum(axis=1).max())
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            first = np.argsort(-(part @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]
            s = part @ self.known.T
            near = np.argpartition(-s, k, axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.tile(np.arange(s.shape[1]), (len(s), 1))
            least = np.take_along_axis(s, near, axis=1).min(axis=1) - 1e-12 * length * np.sqrt((part * part).sum(axis=1))
            least = least if s.shape[1] > k else np.full(len(part), -np.inf)
            out += [(np.union1d(a, self.known_lists[b]), c) for a, b, c in zip(first, near, least.tolist(), strict=True)]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the values of the codes."""
        return np.stack([(q[:, m * PART : (m + 1) * PART] @ b.T).astype(np.float32) for m, b in enumerate(self.books)])

    def scores(self, q: np.ndarray, tables: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries and the coded vectors of one list: of query and
        centroid, plus a table entry for each part of the residual."""
        out = np.repeat((q @ self.centroids[of]).astype(np.float32)[:, None], len(codes), axis=1)
        for m, table in enumerate(tables):
            out += table[:, codes[:, m]]
        return out


def fit(sample: np.ndarray, n: int, seed: int = 7, queries: np.ndarray | None = None, longest: np.ndarray | None = None) -> Index:
    """An index for ``n`` vectors from a sample of them, some of the queries (failing that,
    some of the sample) and the longest vectors."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, max(1, min(MAX_LISTS, int(n**0.5))), rng)
    at = _nearest(sample, centroids)
    rest = sample - centroids[at]
    books = [_kmeans(rest[:, m : m + PART], CODES, rng, 6) for m in range(0, sample.shape[1], PART)]
    known = sample if longest is None else np.unique(np.concatenate([sample, longest]), axis=0)
    index = Index(centroids, books, len(centroids), known, _nearest(known, centroids))
    q = sample[rng.choice(len(sample), min(ASKED, len(sample)), replace=False)] if queries is None or not len(queries) else queries
    need = []
    for x in q:
        s = sample @ x
        s[(sample == x).all(axis=1)] = -np.inf
        top = np.argsort(-s, kind="stable")[:K]
        rank = np.argsort(np.argsort(-(centroids @ x), kind="stable"))
        need += rank[at[top[s[top] > -np.inf]]].tolist()
    if need:
        index.probes = int(np.sort(need)[int((len(need) - 1) * PROBE_RECALL)]) + 1
    return index


def scan(index: Index, lists: np.ndarray, codes: np.ndarray, errors: np.ndarray, vectors: np.ndarray, q: np.ndarray, probes: list[np.ndarray], least: np.ndarray, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the places of its ``k + 1`` best, or more, among a block's rows, sorted by list, and
    their exact scores; only rows of its lists that reach ``least`` count. The best by code
    are ranked first; then all those that, by the error of their codes, could be better
    than the last of them."""
    here, starts = np.unique(lists, return_index=True)
    stops = np.append(starts[1:], len(lists))
    for i in range(0, len(q), CHUNK):
        part, tables = q[i : i + CHUNK], index.tables(q[i : i + CHUNK])
        probing = np.repeat(np.arange(len(part)), [len(p) for p in probes[i : i + CHUNK]])
        probed = np.concatenate(probes[i : i + CHUNK])
        near = np.full((len(part), len(lists)), -np.inf, dtype=np.float32)
        for at, start, stop in zip(here.tolist(), starts.tolist(), stops.tolist(), strict=True):
            if len(rows := probing[probed == at]):
                near[rows, start:stop] = index.scores(part[rows], tables[:, rows], at, codes[start:stop])
        for x, row, low in zip(part, near, least[i : i + CHUNK], strict=True):
            first = np.argpartition(row, -AGAIN)[-AGAIN:] if len(row) > AGAIN else np.arange(len(row))
            first = first[row[first] > -np.inf]
            exact = (vectors[first] * x).sum(axis=1)
            bound = max(low, np.partition(exact, -k - 1)[-k - 1]) if len(exact) > k else low
            row[first] = -np.inf
            length = float(np.sqrt((x * x).sum()))
            more = np.flatnonzero(row + np.float32(length) * errors >= bound - 1e-5 * abs(bound)) if bound > -np.inf else np.flatnonzero(row > -np.inf)
            at = np.concatenate([first, more])
            exact = np.concatenate([exact, (vectors[more] * x).sum(axis=1)])
            good = exact >= bound
            at, exact = at[good], exact[good]
            yield at, exact


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part: a vec_id, as many
    components as most vectors have, all finite, not all zero. Of rows that repeat a
    vec_id the smallest vector counts."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0))


def _best(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task drops the others before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """``(vec_id, embedding, print1, print2)`` -> one row per vector: ``(vid, embedding,
    copies, print1, print2)`` with the ids of its ``k + 1`` first copies, ``vid`` being the
    first."""
    few = _best(rows, [*PRINT], ["vec_id"], k + 1)
    return few.groupBy(*PRINT).agg(F.min_by("embedding", "vec_id").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("copies")).withColumn("vid", F.col("copies")[0])


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """``(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``: for each row
    that ``is_query`` holds for, its ``k`` nearest others found (all, if fewer), by
    inner product, ties to the smaller vec_id. Vectors that are null, zero or hold null
    or non-finite components take no part, nor do those of another dimension than most;
    of rows that repeat a vec_id the smallest vector counts. Other columns are ignored.
    An empty table gives an empty result."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = usable(vectors)
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.select("*", *[F.xxhash64(F.lit(i), "embedding").alias(p) for i, p in enumerate(PRINT)])
    distinct = cut(_distinct(rows, k), "distinct")
    few = distinct.where(F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < int(1e6 * min(1.0, 0.95 * SAMPLE / n)) if n > SAMPLE else F.lit(True))
    matrix = lambda some: np.array(some.select("embedding").toPandas()["embedding"].tolist(), dtype=np.float64)
    sample = matrix(few)
    if not len(sample):  # a handful of vectors with a great many copies
        sample = matrix(distinct.limit(SAMPLE))
    asked = rows.where(is_query).select(*PRINT).distinct().join(distinct, [*PRINT]).select("vid", "embedding")
    longest = distinct.orderBy(F.desc(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), "vid").limit(LONGEST)
    index = fit(sample, n, queries=matrix(asked.orderBy(F.xxhash64("vid")).limit(ASKED)), longest=matrix(longest))
    sent = spark.sparkContext.broadcast(index)

    @F.pandas_udf("struct<list:int,code:binary,error:float,own:binary>")
    def code(x: pd.Series) -> pd.DataFrame:
        own = np.stack(x.to_numpy()).astype(np.float64)
        lists = sent.value.lists(own)
        codes = sent.value.codes(own, lists)
        error = SIGMAS * np.sqrt(((own - sent.value.decoded(lists, codes)) ** 2).mean(axis=1))
        return pd.DataFrame({"list": lists.astype(np.int32), "code": [c.tobytes() for c in codes], "error": error.astype(np.float32), "own": [v.tobytes() for v in own]})

    coded = cut(distinct.select("vid", code("embedding").alias("c")).select("vid", "c.*"), "index")
    # Neighbouring lists share a block up to its size, and a longer list has several.
    # There are at most MAX_LISTS counts.
    blocks_of: dict[int, tuple[int, int]] = {}
    block, room = -1, 0
    for r in coded.groupBy("list").count().orderBy("list").collect():
        if r["count"] > room:
            block, room = block + 1, VECTORS
        parts = -(-r["count"] // VECTORS)
        blocks_of[r["list"]] = (block, parts)
        room -= r["count"]
        if parts > 1:
            block, room = block + parts - 1, 0
    first = F.broadcast(spark.createDataFrame([(a, b, c) for a, (b, c) in blocks_of.items()], "list int, block int, parts int"))
    own_block = (F.col("block") + F.pmod(F.xxhash64("vid"), F.col("parts"))).cast("int").alias("block")
    filed = coded.join(first, "list").select(own_block, "vid", "list", "code", "error", "own")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            out = []
            for vid, x, (lists, least) in zip(b["vid"], q, sent.value.probed(q, k), strict=True):
                by_block: dict[int, list[int]] = {}
                for at in lists.tolist():
                    start, parts = blocks_of.get(at, (0, 0))
                    for i in range(start, start + parts):
                        by_block.setdefault(i, []).append(at)
                out += [(i, vid, x.tobytes(), np.array(ls, dtype="<i4").tobytes(), least) for i, ls in by_block.items()]
            yield pd.DataFrame(out, columns=["block", "vid", "query", "lists", "least"])

    asks = cut(asked.mapInPandas(ask, "block int, vid long, query binary, lists binary, least double"), "asks")
    # Codes are repeated for the queries that do come to their block, and no others.
    crowds = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("crowds"))
    left = filed.join(crowds, "block").select("block", F.explode(F.expr("sequence(0, crowds - 1)")).alias("batch"), "vid", "list", "code", "error", "own")
    right = asks.join(crowds, "block").select("block", F.pmod(F.xxhash64("vid"), F.col("crowds")).cast("int").alias("batch"), "vid", "query", "lists", "least")

    def run(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        ids, scores, of = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if len(found) and len(asking):
            found = found.sort_values(["list", "vid"])
            name, lists = found["vid"].to_numpy(), found["list"].to_numpy()
            codes = np.frombuffer(b"".join(found["code"]), dtype=np.uint8).reshape(len(found), -1)
            vectors = np.frombuffer(b"".join(found["own"]), dtype=np.float64).reshape(len(found), -1)
            q = np.frombuffer(b"".join(asking["query"]), dtype=np.float64).reshape(len(asking), -1)
            probes = [np.frombuffer(x, dtype="<i4") for x in asking["lists"]]
            for mine, (at, exact) in zip(asking["vid"], scan(sent.value, lists, codes, found["error"].to_numpy(), vectors, q, probes, asking["least"].to_numpy(), k), strict=True):
                best = np.lexsort((name[at], -exact))[: k + 1]
                ids.append(name[at[best]])
                scores.append(exact[best])
                of.append(np.full(len(best), mine))
        return pd.DataFrame({"qid": np.concatenate(of), "vid": np.concatenate(ids), "score": np.concatenate(scores)})

    found = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInPandas(run, "qid long, vid long, score double")
    top = _best(found, ["qid"], [F.desc("score"), "vid"], k + 1).drop("rank").join(distinct.select("vid", "copies"), "vid").select("qid", "score", F.explode("copies").alias("vec_id"))
    top = _best(top, ["qid"], [F.desc("score"), "vec_id"], k + 1).select("qid", "score", "vec_id")
    members = rows.where(is_query).select(F.col("vec_id").alias("query_id"), *PRINT).join(distinct.select(*PRINT, F.col("vid").alias("qid")), [*PRINT]).select("query_id", "qid")
    found = members.join(top, "qid").where("query_id <> vec_id")
    return _best(found, ["query_id"], [F.desc("score"), "vec_id"], k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op9_nearest_neighbours": op9_nearest_neighbours}
ORACLES: dict[str, str] = {}
