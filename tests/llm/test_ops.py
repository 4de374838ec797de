"""The ten operators against brute force, on awkward rows and on the small tables."""

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fundcat.llm import ann, graph, licenses, mixing, pieces, quality, repair, sharding, simhash, token_counts, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, unit string, rate double"
LONG = "lorem ipsum dolor sit amet " * 3000 + "Ünïcödé — １２３ <|endoftext|> it's " + "ab" * 3000
TEXTS = [None, "", " \n\t", "one", "one two three four five", "One  two\tthree four FIVE", LONG, "x" * 5000, "a. b, c!? ..", "<|endoftext|><|EndOfText|>", "  two  spaces\n\nand\nlines  nbsp 　wide ", "日本語のテキスト と English", "emoji 😀👍🏽 ñandú œuvre", "Licensed under the Apache License, Version 2.0."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, 7, "u", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "one", "en", "s1", 1, 1, "u", 0.1), (3, "one", "en", "s0", 3, 7, "u", 0.5), (3, "one", "en", "s0", 3, 7, "u", 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- 1


def brute_print(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(x).encode(), seed=42).intdigest() for x in ([w[i : i + 4] for i in range(len(w) - 3)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["docs", "small"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").toPandas()
    ids = [None if pd.isna(i) else int(i) for i in rows.doc_id]
    prints = [brute_print(t) for t in rows.text]
    groups = {}
    for i, r in enumerate(brute_roots(prints)):
        groups.setdefault(r, []).append(i)
    want = []
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        want += [(ids[i], f"{prints[i]:016x}", min(known) if known else None) for i in members]
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dense_and_split_cells_lose_no_link(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(600)} | set(map(int, rng.integers(0, 1 << 62, 200)))
    prints = sorted(simhash._signed(p & (1 << 64) - 1) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for block in (2048, 50):
        roots = dict(graph.components(simhash.links(df, block=block)).collect())
        want = brute_roots([p & (1 << 64) - 1 for p in prints])
        assert [roots.get(p, p) for p in prints] == [prints[r] for r in want]


def test_embedding_is_a_lower_bound(spark):
    a, b = 0x0123456789ABCDEF, 0x0F23A56780ABCD1F
    e = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(a,), (b,)], "fp long").select(simhash.embedding(F.col("fp"))).collect()]
    counts = [[(x >> 2 * s & 3).bit_count() for s in range(32)] for x in (a, b)]
    manhattan = sum(abs(x - y) for x, y in zip(*counts, strict=True))
    assert (e[0] ^ e[1]).bit_count() == manhattan <= (a ^ b).bit_count()


def test_deduplicate(docs):
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (900, 901)], "a long, b long")
    roots = dict(graph.components(edges).collect())
    assert all(roots[i] == 0 for i in range(1, 201)) and roots[901] == 900


# ---- 2


def test_shards(docs, small):
    for df in (docs, small):
        out = sharding.shard(df, 16).toPandas()
        assert len(out) == df.count()
        assert ((out.grown_shard == out.shard) | (out.grown_shard == 16)).all()
        for _, part in out.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
    text = small.toPandas().set_index("doc_id").text
    out = out.set_index("doc_id")
    assert all(out.loc[i, "size"] == len(t.encode()) + 1 and out.loc[i, "text_crc32"] == zlib.crc32(t.encode()) for i, t in text.items())


def test_jump_moves_only_what_it_must():
    keys = np.random.default_rng(0).integers(0, 1 << 62, 20000).astype(np.uint64)
    with np.errstate(over="ignore"):
        a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and abs((a != b).mean() - 1 / 17) < 0.01 and np.bincount(a).min() > 1000


# ---- 3


def test_tokens_round_trip(docs, small, spark, tmp_path):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for k, df in enumerate((docs, small)):
        repair.write_tokens(df, str(tmp_path / f"t{k}"), shard_ids=3000)
        got = repair.read_tokens(spark, str(tmp_path / f"t{k}")).orderBy("start").collect()
        rows = [(None if pd.isna(i) else int(i), x or "") for i, x in df.select("doc_id", "text").toPandas().values]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        start = 0
        for r, (i, text) in zip(got, rows, strict=True):
            ids = [*t.encode(text, add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_grammar():
    rng = np.random.default_rng(2)
    docs = [np.append(rng.choice(30, n, p=np.r_[0.5, np.full(29, 0.5 / 29)]), 1).astype("<u4") for n in (0, 1, 5000, 3, 20000)] + [np.zeros(3000, "<u4")]
    payload = repair.pack([d.tobytes() for d in docs], 100)
    shard = repair.Shard(payload)
    assert len(shard.rules) > 0 and len(payload) < 4 * sum(map(len, docs))
    assert all((a == b).all() for a, b in zip(shard.documents(), docs, strict=True))
    assert (shard.document(4) == docs[4]).all() and all(shard.id_at(4, p) == docs[4][p] for p in (0, 1, 777, 19999, 20000))
    assert (repair.lengths(shard.rules, 100) == [len(repair.expand(np.array([100 + k]), shard.rules, 100)) for k in range(len(shard.rules))]).all()


# ---- 4


def test_pieces_equal_the_library(docs, small):
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (docs, small):
        for frequent in (pieces.FREQUENT, 3):
            for r in pieces.encode(df.select("*", F.col("text").alias("t")), frequent=frequent).join(df.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
                assert r.ids == m.encode(r.t or "") and r.round_trip and r.n_pieces == len(r.ids)
    assert pieces.encode(docs).count() == docs.count()


def test_pieces_of_odd_texts(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    odd = ["zqxj " * 50, "  two  spaces \n\n ends ", "a▁b ▁", "zqxjk zqxjk vvwq zqxjk.", "x" * 200 + " " + "qé" * 90, "\n", " ", "日本 語\0\t#*", "", None]
    odd += ["".join(rng.choice(list("abqxzé .\n▁#日0"), 60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, odd[3]), (3, odd[3]), (None, odd[3]), (None, None), (0, "zqxj")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(((-1 if i is None else i), m.encode(t or ""), "▁" not in (t or "")) for i, t in rows)
    for sample in (pieces.SAMPLE, 2):
        got = pieces.encode(df, frequent=40, sample=sample).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, r.round_trip) for r in got) == want


def test_pieces_read_a_text_once(docs, monkeypatch):
    seen = docs.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    known = pieces._known
    monkeypatch.setattr(pieces, "_known", lambda rows, *rest: known(docs.select("doc_id", "text"), *rest))
    out = pieces.encode(docs.select("doc_id", "text").mapInArrow(count, "doc_id long, text string"), frequent=3).collect()
    assert len(out) == seen.value == docs.count()


def test_decode(docs):
    out = pieces.decode(pieces.encode(docs)).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct(), "doc_id")
    assert out.where("text <> t").count() == 0


def test_viterbi_fold_is_the_best_path(spark):
    model = pieces.Model({"a": (1, -1.0), "b": (2, -1.5), "ab": (3, -2.0), "ba": (4, -1.2), "aba": (5, -4.0), "c": (6, -0.5)}, 100, ())
    names = ["a", "abab", "ababa", "cabz", "bbaab"]
    words_ = spark.createDataFrame([(n, 1) for n in names], "unit string, n long").repartition(2, "unit")
    got = dict(pieces.lattice(words_, model).select("unit", pieces.viterbi_fold(F.col("edges"), F.length("unit"), -10.0)).collect())

    def score(text, ends):
        return sum(model.pieces.get(text[i:j], (0, -10.0 if j == i + 1 else -1e9))[1] for i, j in zip(ends, ends[1:], strict=False))

    def all_paths(n, at=0):
        if at == n:
            yield [n]
        for j in range(at + 1, min(n, at + 3) + 1):
            for rest in all_paths(n, j):
                yield [at, *rest]

    for n in names:
        assert score(n, got[n]) == pytest.approx(max(score(n, p) for p in all_paths(len(n))))


# ---- 5


def test_toxicity_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.classify(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (r.predicted == (r.score >= 0.7)).all()
    assert (r.predicted == r.toxic).mean() > 0.96 and r[r.toxic == 0].predicted.mean() < 0.01


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows, marks = [], []
    for i in range(900):
        group = ("muslim", "christian")[i % 2]
        nasty = i % 3 == 0 and (group == "muslim" or i % 9 == 0)
        rows.append((i, f"the {group} person went home w{i % 7} " + ("slur" if nasty and i % 2 else "vile" if nasty else "calm")))
        marks.append((i, 1 if nasty or (group == "muslim" and i % 5 == 0) else 0))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    gap = {}
    for swap in (0.0, 5.0):
        m = toxicity.train(d, lab, swap=swap)
        gap[swap] = abs(m.score("a muslim person") - m.score("a christian person"))
    assert gap[5.0] < gap[0.0] / 2


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or predicted is null or held_out is null").count() == 0
    assert toxicity.classify(empty, labels).count() == 0


# ---- 6


def test_token_counts(docs, small):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (docs, small):
        text = df.select("doc_id", "text").toPandas()
        want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in zip(text.doc_id, text.text, strict=True))
        got = token_counts.token_counts(df).toPandas()
        assert sorted(zip(map(str, got.doc_id), got.n_bytes, got.n_tokens, strict=True)) == want
        assert (got.over_limit == (got.n_tokens > 512)).all()


# ---- 7


def brute_license(text):
    best = (0.0, None)
    for line in (text or "").split("\n"):
        own = licenses.bigrams(line)
        for name, template in licenses.TEMPLATES:
            b = licenses.bigrams(template)
            if own and (d := 2 * len(own & b) / (len(own) + len(b))) >= licenses.THRESHOLD:
                best = max(best, (d, name), key=lambda x: x[0])
    return best[1]


def test_licenses(docs, small):
    for df in (docs, small):
        got = licenses.scan(df).toPandas()
        assert len(got) == df.count()
        text = df.select("doc_id", "text").where("doc_id is not null").toPandas().drop_duplicates().set_index("doc_id").text
        assert all(r.license == brute_license(text[r.doc_id]) for r in got[got.doc_id.notna()].itertuples())
    text = "Intro\n\nLicensed under the Apache License,\nVersion 2.0.\n\nEnd"
    found = licenses.Scanner().scan(text)
    assert {m[0] for m in found} == {"Apache-2.0"} and ("Apache-2.0", 1.0, 7, 54) in [(*m[:3], m[3]) for m in found]


# ---- 8


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(20, 200))) + " |" * int(rng.integers(15, 30) if i % 4 == 0 else 0)) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, "low" if i % 4 == 0 else "high") for i in range(0, 600)], "doc_id long, domain string")
    out = mixing.mix(d, lab, {"high": 0.9, "low": 0.1}).toPandas()
    assert (out.rate >= 0).all() and np.allclose(out.p_high + out.p_low, 1)
    total = out.tokens.sum()
    assert (out.rate * out.tokens * out.p_low).sum() / total == pytest.approx(0.1, abs=1e-4)
    assert (out.rate * out.tokens * out.p_high).sum() / total == pytest.approx(0.9, abs=1e-4)
    assert (out.p_low > 0.5).to_numpy()[out.doc_id % 4 == 0].mean() > 0.95
    assert mixing.resample(d, lab, {"high": 0.9, "low": 0.1}).columns == d.columns


def test_mixing_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(docs, none).count() == docs.count() and mixing.mix(empty, none).count() == 0
    assert mixing.resample(docs, none).columns == docs.columns


# ---- 9


def test_neighbours(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = ann.search(e, F.col("vec_id") % 20 == 0).toPandas()
    v = e.toPandas().dropna()
    x = np.stack(v.embedding).astype(float)
    hit = 0
    for q, part in got.groupby("query_id"):
        s = (x * x[v.vec_id == q][0]).sum(axis=1)
        s[v.vec_id == q] = -9
        hit += len(set(part.vec_id) & set(v.vec_id.to_numpy()[np.lexsort((v.vec_id, -s))[:20]]))
        assert list(part.sort_values("rank").vec_id) == [i for _, i in sorted(zip(-part.score, part.vec_id, strict=True))]
    assert hit / len(got) >= 0.9


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (2, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(e, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (20, 0.0), (20, 1): (0, 0.0), (20, 2): (1, 0.0), (20, 3): (2, 0.0)}
    assert ann.search(e.where("false"), F.lit(True)).count() == 0


def test_neighbours_in_dense_groups(spark):
    """Groups of more vectors than are ranked again in any case, whose codes hardly differ."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 64))[rng.integers(0, 6, 6000)] + 0.02 * rng.normal(size=(6000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    e = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    hit = 0
    for q, part in ann.search(e, F.col("vec_id") % 60 == 0).toPandas().groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hit += len(set(part.vec_id) & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit / 2000 >= 0.97


def test_many_equal_vectors_are_ranked_by_id(spark):
    e = spark.createDataFrame([(i, [1.0, 2.0, 0.5, 0.1]) for i in range(1500)], "vec_id long, embedding array<float>")
    got = ann.search(e, F.col("vec_id") == 700).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


# ---- 10


def brute_stats(text):
    text = text or ""
    w, lines, at, covered = words(text), [x for x in text.split("\n") if words(x)], {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for starts in at.values():
        if len(starts) > 1:
            for i in starts:
                covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, small):
    for df in (docs, small):
        text = df.select("doc_id", "text").where("doc_id is not null").toPandas().drop_duplicates().set_index("doc_id").text
        out = quality.judge(df).toPandas()
        assert len(out) == df.count() and not out.kept.isna().any()
        for r in out[out.doc_id.notna()].itertuples():
            want = brute_stats(text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_covariance_steps_equal_numpy(spark):
    rng = np.random.default_rng(4)
    n, d = 400, len(quality.FEATURES)
    stats = pd.DataFrame({"doc_id": range(n), "lang": "en", "source": "s", "n_words": rng.integers(50, 900, n), "n_dup_lines": 0, "n_repeat_words": 0})
    stats["word_chars"] = (stats.n_words * rng.uniform(4.5, 5.5, n)).astype(int)
    stats["n_symbols"] = np.where(np.arange(n) < 40, stats.word_chars // 4, 0)
    stats["base_failed"] = False
    out = quality.robust_distances(spark.createDataFrame(stats)).toPandas().sort_values("doc_id")
    w, c = stats.n_words.to_numpy(float), stats.word_chars.to_numpy(float)
    x = np.stack([np.log(w), np.log(c / w), np.log(1 + 100 * stats.n_symbols / c), np.zeros(n), np.zeros(n)], axis=1)
    floor = np.array([f[2] for f in quality.FEATURES])
    bucket = lambda d2: np.floor(np.log(d2 + 1e-9) * 100)
    factor = quality.H / quality.chi2_cdf(quality.chi2_quantile(quality.H, d), d + 2)

    def fit(rows, by):
        cov = by * np.cov(rows.T, bias=True) + np.diag(floor**2)
        return rows.mean(axis=0), cov, np.linalg.slogdet(cov)[1]

    def distances(mean, cov):
        return ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)

    def step(model):
        b = bucket(distances(*model[:2]))
        return fit(x[b <= np.sort(b)[int(np.ceil(quality.H * n)) - 1]], factor)

    ends = []
    for start in ((np.sort(np.round(x * 1000), axis=0)[int(np.ceil(n / 2)) - 1] / 1000, np.diag(floor**2)), fit(x, 1.0)):
        model = step(start)
        while (after := step(model))[2] < model[2] - quality.FALL:
            model = after
        ends.append(model)
    d2 = distances(*min(ends, key=lambda m: m[2])[:2])
    assert np.allclose(out.d2, d2)
    limit = quality.chi2_quantile(1 - quality.ALPHA, d)
    assert (out.d2[:40] > limit).all() and (out.d2[40:] < limit).mean() > 0.99


def test_empty_tables(empty):
    for f in (simhash.near_duplicates, sharding.shard, pieces.encode, token_counts.token_counts, licenses.scan, quality.judge):
        assert f(empty).count() == 0
    assert quality.reject(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_empty_tokens(empty, spark, tmp_path):
    repair.write_tokens(empty, str(tmp_path / "none"))
    assert repair.read_tokens(spark, str(tmp_path / "none")).count() == 0
