"""Packing, fill-in-the-middle and periodic runs against brute force, on awkward rows and
on the small tables."""

import hashlib
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fundcat.llm import fim, packing, runs

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, form string, length long, part int, digest string, w string, runs string"
LONG = "lorem ipsum dolor sit amet " * 3000 + "Ünïcödé — １２３ <|endoftext|> it's " + "ab " * 3000
TEXTS = [None, "", " \n\t", "one", "  one", "one two  ", "a <P> b", "x" * 5000, LONG, "日本語の テキスト と English", "emoji 😀👍🏽 ñandú\n\nœuvre", "<S", "nbsp 　wide is a word", "a b " * 40, "c " * 6, "c " * 5, "a a a a b a a a a b " * 5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"tick tock {i} 😀 {'la di da ' * (i % 7)}end") for i in range(60)]
    rows += [(None, "one two three"), (3, "one"), (3, "one"), (None, None)]
    return spark.createDataFrame([(*r, 7, "u", 1, 2, "d", "w", "r") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- packing


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 100_001):
        got = packing.piece_lengths(n)
        assert sum(got) == n and got == sorted(got, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert len({x for x in got if x < 2048}) == len([x for x in got if x < 2048])
    assert packing.piece_lengths(11, 4) == [4, 4, 2, 1]


@pytest.mark.parametrize("which", ["docs", "small"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for key, text in _rows(df):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for length in packing.piece_lengths(len(ids)):
            want.append((key, at, length, zlib.crc32(array("I", ids[at : at + length]).tobytes()), len(ids)))
            at += length
        assert at == len(ids)
    packed = packing.pack(df).select("doc_id", "start", "length", F.crc32("ids").alias("c"), "doc_tokens", "sequence_id", "offset").collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == sorted(want, key=str)
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed))) and {r.offset for r in packed} == {0}
    by_id = [r.length for r in sorted(packed, key=lambda r: r.sequence_id)]
    assert by_id == sorted(by_id, reverse=True)


def test_packing_of_an_empty_table_and_wrong_length(docs):
    assert packing.pack(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, longest=1000)


def test_buckets_are_written_and_read(spark, docs, tmp_path):
    packed = packing.pack(docs, longest=64)
    packing.write_buckets(packed, str(tmp_path / "b"), rows_per_file=50)
    want = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packed.collect()}
    got = {}
    for k in range(7):
        part = packing.read_bucket(spark, str(tmp_path / "b"), 1 << k).collect()
        assert all(len(r.ids) == 1 << k for r in part)
        got |= {r.sequence_id: r.ids for r in part}
    assert got == want
    assert len(list((tmp_path / "b" / "length=64").glob("*.parquet"))) > 5


# ---- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, sha(text), sha(text)
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return key, n, "spm" if h4 % 100 < 80 else "psm", len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("which", ["docs", "small"])
def test_fill_in_middle(request, which):
    df = request.getfixturevalue(which)
    out = fim.rearrange(df)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("o"), F.sha2(fim.restored(), 256).alias("r"))
    want = sorted((brute_fim(*r) for r in _rows(df)), key=str)
    assert _got(got) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    texts = dict(_rows(df.where("doc_id >= 100")))
    for r in out.where("doc_id >= 100 and form <> 'plain'").collect():
        raw = texts[r.doc_id].encode()
        assert raw[: r.prefix_bytes].decode() == texts[r.doc_id][: r.prefix_chars]
        assert raw[r.prefix_bytes :][: r.middle_bytes].decode() == texts[r.doc_id][r.prefix_chars :][: r.middle_chars]
    assert fim.rearrange(df.where("false")).collect() == []


def test_fill_in_middle_sql(docs):
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by DuckDB
    documents["doc_id"] = documents.doc_id.astype("Int64")
    want = duckdb.sql(fim.ORACLES["op12_fill_in_middle"]).fetchall()
    assert sorted((tuple(r) for r in want), key=str) == sorted((brute_fim(*r) for r in _rows(docs)), key=str)


def test_exception_index():
    for text in ("", "plain ascii", "é", "日本 é x 😀😀 y", "aé" * 50):
        index = fim.ExceptionIndex(np.frombuffer(text.encode(), dtype=np.uint8))
        chars = np.arange(len(text) + 1)
        want = np.array([len(text[:i].encode()) for i in chars])
        assert index.to_bytes(chars).tolist() == want.tolist() and index.to_chars(want).tolist() == chars.tolist()
        assert len(index.at) == sum(c > "\x7f" for c in text)


# ---- runs


def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # periods grow, so the first is the smallest
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_op13(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = None if key is None else zlib.crc32(str(key).encode()), len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else None
    cols = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return key, len(found), *cols, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def op13(spark, df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return runs.op13_periodic_runs(spark, str(folder))


def test_periodic_runs(spark, docs, tmp_path):
    more = spark.createDataFrame([(i, " ".join(str((i * k) % 11) for k in range(i % 97))) for i in range(1000, 1400)], "doc_id long, text string")
    df = docs.where("doc_id is null or doc_id <> 8").unionByName(more, allowMissingColumns=True)
    got = _got(op13(spark, df, tmp_path / "a"))
    assert got == sorted((brute_op13(*r) for r in _rows(df)), key=str)
    assert sum(r[1] > 0 for r in got) > 40
    assert op13(spark, docs.where("false"), tmp_path / "b").collect() == []


def test_periodic_runs_on_the_small_table(spark, small, tmp_path):
    short = small.where("length(text) < 6000")  # brute force is quadratic
    assert _got(op13(spark, short, tmp_path / "a")) == sorted((brute_op13(*r) for r in _rows(short)), key=str)


def test_runs_of_a_very_long_text(spark, docs):
    row = runs.find_runs(docs.where("doc_id = 8")).first()
    assert [tuple(r) for r in row.runs] == [(0, 15000, 5), (15005, 3000, 1)]
    assert row.collapsed == "lorem ipsum dolor sit amet Ünïcödé — １２３ <|endoftext|> it's ab" and row.n_words == 18005


def test_runs_do_not_hang_on_the_grammar():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.choice((0, 1, 7, 40, 120)), rng.choice((1, 2, 3, 9))
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randrange(1, n // 4 + 2)
                w = [x if i < a else w[min(n - 1, a + (i - a) % p)] for i, x in enumerate(w)]
            texts += [w] * rng.choice((1, 1, 2))
        flat = np.array([x for w in texts for x in w], dtype=np.int64)
        got = list(zip(*(x.tolist() for x in runs.group_runs(flat, np.array([len(w) for w in texts]))), strict=True))
        base, want = 0, []
        for w in texts:
            want += [(s + base, e + base, q) for s, e, q in brute_runs(w)]
            base += len(w)
        assert got == want
