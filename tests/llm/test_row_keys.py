"""Rows whose doc_id is null or repeated are decided one by one."""

import random

from fundcat.llm import quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string"


def _text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(("river", "stone", "cloud", "market", "window", "garden", "letter", "bridge", "winter", "music")) + str(rng.randrange(500)) for _ in range(n))


def _got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_deduplicate_keeps_one_row_of_each_component(spark):
    a, b, c, d, e = map(_text, range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (9, d), (None, e), (None, e), (3, e), (8, b.upper()), (8, b.upper())]
    out = simhash.deduplicate(spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA))
    assert _got(out) == sorted([(None, a), (8, b.upper()), (7, c), (7, d), (3, e)], key=str)


def test_deduplicate_keeps_one_of_rows_that_differ_elsewhere(spark):
    a = _text(1)
    out = simhash.deduplicate(spark.createDataFrame([(1, a, "en", None), (1, a, None, "en"), (None, a, "en", "s")], SCHEMA))
    assert _got(out) == [(1, a)]


def test_reject_judges_rows_that_share_a_doc_id(spark):
    good = [_text(i) for i in range(80)]
    rows = [(i, t) for i, t in enumerate(good)] + [(None, good[0] + " end"), (None, "too short"), (5, "short too"), (6, good[6])]
    out = quality.reject(spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA))
    assert _got(out) == sorted([r for r in rows if "short" not in r[1]], key=str)
