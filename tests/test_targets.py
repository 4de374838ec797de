"""Standing searches against a plain loop over jobs and programs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fundcat.fixtures import Catalog
from fundcat.operators import publication as U

NOW = dt.datetime(2024, 1, 31)
JOBS = "job_id long, q string, categories array<string>, focus array<string>, applicant string, min_award double, freshness string, country string, state string, city string"
CARDS = "id string, said string, status string, categories array<string>, known_categories boolean, applicants array<string>, maximum_award double, checked timestamp, created_at timestamp, catalog_updated_at timestamp"
GEOS = "opportunity_id string, country string, state string, city string, rule string"


def run(spark, jobs, cards, geos):
    out = U.target_match(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(cards, CARDS), spark.createDataFrame(geos, GEOS), "2024-01-31")
    return {(r.job_id, r.id): r.strict for r in out.collect()}


def test_unknown_requirements_are_no_strict_match(spark):
    job = dict(job_id=1, q=None, categories=["Music"], focus=None, applicant="individual", min_award=None, freshness=None, country="Canada", state=None, city=None)
    card = dict(id="a", said="northern music fellowship grant", status="open", categories=["Music"], known_categories=True, applicants=["individual"], maximum_award=None, checked=NOW, created_at=NOW, catalog_updated_at=None)
    here, away = ("Canada", None, None, "eligible"), ("United States", None, None, "eligible")
    cases = [
        ({}, {}, here, True), ({}, {"checked": dt.datetime(2000, 1, 1)}, here, False), ({}, {"applicants": []}, here, False), ({}, {"applicants": ["business"]}, here, None), ({}, {}, None, False), ({}, {}, away, None),
        ({}, {"known_categories": False}, here, False), ({}, {"categories": [], "known_categories": False}, here, False), ({"categories": []}, {"categories": [], "known_categories": False}, here, True), ({"min_award": 100.0}, {}, here, False),
        ({"applicant": None}, {}, here, None), ({"country": None}, {}, here, None), ({"q": "  MUSIC orthern "}, {}, here, True), ({"q": "music film"}, {}, here, None),
    ]
    jobs = [tuple((job | j | {"job_id": i}).values()) for i, (j, _, _, _) in enumerate(cases)]
    cards = [tuple((card | c | {"id": f"a{i}"}).values()) for i, (_, c, _, _) in enumerate(cases)]
    got = run(spark, jobs, cards, [(f"a{i}", *g) for i, (_, _, g, _) in enumerate(cases) if g])
    assert [got.get((i, f"a{i}")) for i in range(len(cases))] == [want for *_, want in cases]


def test_searches_as_by_a_plain_loop(spark):
    rng = random.Random(7)
    words = ["music", "rural", "women", "grant", "fund", "artists", "x"]
    cards = []
    for i in range(150):
        own = rng.sample(["Music", "Film", "Dance"], rng.randrange(3))
        cards.append((f"o{i}", " ".join(rng.choice(words) for _ in range(6)), rng.choice(["open", "unknown"]), own, bool(own) and rng.random() < 0.8, rng.sample(["individual", "business"], rng.randrange(3)), rng.choice([None, 50.0, 500.0]), rng.choice([None, NOW, NOW - dt.timedelta(days=3)]), NOW - dt.timedelta(days=rng.randrange(14)), rng.choice([None, NOW, NOW - dt.timedelta(days=9)])))
    jobs = [(i, rng.choice(["", "music", "omen un", "x grant", "zebra"]), rng.choice([[], None, ["Music"], ["Film", "Dance"]]), rng.choice([[], ["rural"], ["women", "rural"]]), rng.choice(["individual", "business", ""]), rng.choice([None, 0.0, 100.0]), rng.choice(["", "new", "updated"]), rng.choice(["Canada", "France", None]), None, None) for i in range(120)]
    geos = [(f"o{i}", rng.choice(["Canada", "France"]), None, None, rng.choice(["eligible", "eligible", "excluded"])) for i in range(150) if rng.random() < 0.7]
    want = {}
    for j, q, cats, focus, applicant, least, fresh, country, _, _ in jobs:
        for i, said, _, own, known, kinds, most, checked, made, updated in cards:
            rules = [g for g in geos if g[0] == i]
            here = "excluded" if any(g[4] == "excluded" and g[1] == country for g in rules) else "eligible" if any(g[4] == "eligible" and g[1] == country for g in rules) else "excluded" if any(g[4] == "eligible" for g in rules) else "unknown"
            shared = known and bool(set(own) & set(cats or []))
            ok = applicant and country and all(t in said for t in q.split()) and (not focus or set(focus) & set(said.split())) and (not cats or shared or not known) and (applicant in kinds or not kinds) and here != "excluded" and (not least or most is None or most >= least)
            ok = ok and (fresh != "new" or made >= NOW - dt.timedelta(days=7)) and (fresh != "updated" or (updated is not None and updated >= NOW - dt.timedelta(days=7)))
            if ok:
                want[j, i] = bool(applicant in kinds and here == "eligible" and (not cats or shared) and (not least or most is not None) and checked and checked >= NOW - dt.timedelta(days=1))
    assert run(spark, jobs, cards, geos) == want and any(want.values()) and len(want) > 100


def test_counts_follow_the_status_asked_for(spark):
    matches = spark.createDataFrame([(1, "a", "open", True), (1, "b", "open", True), (1, "c", "upcoming", True), (1, "d", "unknown", True), (1, "e", "open", False), (2, "c", "upcoming", True)], "job_id long, id string, status string, strict boolean")
    wide = spark.createDataFrame([(i, NOW, f"https://a.org/{'x' if i in 'ab' else i}") for i in "abcde"], "id string, created_at timestamp, source_url string")
    jobs = spark.createDataFrame([(1, None), (2, "upcoming")], "job_id long, status string")
    got = {r.job_id: (r.matched, r.watchlist, r.research) for r in U.target_counts(matches, wide, jobs).collect()}
    assert got == {1: (1, 1, "d,e"), 2: (1, 1, None)}
    assert U.target_counts(matches.where(F.lit(False)), wide, jobs).count() == 0


def test_jobs_that_ask_the_same_share_an_asker(spark):
    jobs = [(i, "b A" if i % 2 else "a b", ["x"], None, "nonprofit" if i < 8 else None, None, "", "United States", None, None, ["", "open", "upcoming"][i % 3]) for i in range(10)]
    df = spark.createDataFrame(jobs, JOBS + ", status string")
    members, askers = U.same_searches(df)
    assert {(r.job_id, r.asker) for r in members.collect()} == {(i, 2 if i % 3 == 2 else 0) for i in range(8)}
    assert sorted(r.job_id for r in askers.collect()) == [0, 2]


def test_a_table_of_like_rows_counts_by_its_rows(spark, tmp_path):
    spark.range(300_000).selectExpr("id as p_partkey", "repeat('ab', 200) as p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = Catalog(spark, str(tmp_path))["part"]
    plan = spark.range(10).withColumnRenamed("id", "p_partkey").join(rows, "p_partkey", "left")._jdf.queryExecution().sparkPlan().toString()
    assert sum(f.stat().st_size for f in (tmp_path / "part.parquet").glob("*.parquet")) < 10_000_000
    assert "BroadcastHashJoin" not in plan
