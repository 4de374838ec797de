"""Stages on odd rows and clashing names; sharding against the paper's loop; labels that
repeat and conflict."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fundcat.llm import sharding, simhash, toxicity

SMALL = "/root/testdata/sf0.001"
EXTRA = ("_key1", "_KEY2", "__key1", "toxic", "fp", "row", "Text_2", "unit", "rate", "kept")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 5000
    more = spark.createDataFrame([(None, None, None, None), (None, "", "en", "s"), (7, long, "en", "src1"), (7, "x", "en", "src1"), (7, "x", "en", "src1"), (None, long, None, None)], "doc_id long, text string, lang string, source string")
    rows = docs.unionByName(more, allowMissingColumns=True).unionByName(docs.limit(5))
    return rows.withColumns({c: F.lit(i).cast("long") for i, c in enumerate(EXTRA)})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_clashing_names(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SMALL)
    assert out.count() >= 0
    if name != "encoding":
        assert out.columns == odd.columns
        known = {tuple(r) for r in odd.collect()}
        assert all(tuple(r) in known for r in out.collect())
    assert stage(spark, odd.where("false"), SMALL).count() == 0


def test_deduplicate_with_columns_named_as_its_own(spark):
    a, b = ("one two three four five six seven eight " * 9, "nine ten eleven twelve thirteen fourteen " * 9)
    rows = [(1, a, 5, 6), (2, a, 5, 6), (3, b, None, 1), (3, b, None, 1), (None, a, 0, 0)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _key1 long, _key2 long"))
    assert out.columns == ["doc_id", "text", "_key1", "_key2"]
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_loop_of_the_paper():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.array([0, 1, (1 << 64) - 1], dtype=np.uint64)])
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_shards_are_written_whole(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang").withColumn("shard", F.lit("mine"))
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("doc_id", "text", "lang").collect())) == sorted(map(str, docs.select("doc_id", "text", "lang").collect()))
    want = {r.doc_id: r.shard for r in sharding.shard(docs, 4).collect()}
    assert all(want[r.doc_id] == r.shard for r in back.collect())
    sharding.write_shards(docs.where("false"), str(tmp_path / "e"), 4)


def test_labels_that_repeat_and_conflict(spark):
    docs = spark.createDataFrame([(i, ("you vile pest " if i % 2 else "what a fine day ") + f"w{i % 7}") for i in range(200)] * 3 + [(4, "another text of the id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 0) for i in range(0, 200, 3)] + [(None, 1), (8, 5)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 601
    rows = [r for r in rows if r.doc_id != 4]  # one of its texts has no word of the others
    assert {r.predicted for r in rows if r.doc_id % 2} == {1} and {r.predicted for r in rows if r.doc_id % 2 == 0} == {0}
