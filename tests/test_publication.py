"""Jobs without SQL, and branches that the tables do not reach."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fundcat.operators import evidence as E
from fundcat.operators import publication as U


def test_ledger_admits_in_order(spark):
    day = dt.datetime(2024, 1, 30)
    rows = [(i, i % 3, f"t{i * 7 % 11}", day + dt.timedelta(hours=i * 5 % 97)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ledger long, topic_key string, ts timestamp")
    got = dict(U.ledger_admit(df, month_cents=80).collect())
    want = {}
    for ledger in range(3):
        passed = []
        for i, _, topic, ts in sorted((r for r in rows if r[1] == ledger), key=lambda r: (r[3], r[0])):
            month = sum(10 for _, t in passed if (t.year, t.month) == (ts.year, ts.month))
            today = sum(t.date() == ts.date() for _, t in passed)
            again = any(k == topic and ts - t < dt.timedelta(days=7) for k, t in passed)
            want[i] = month + 10 <= 80 and today < 3 and not again
            if want[i]:
                passed.append((topic, ts))
    assert got == want and any(want.values()) and not all(want.values())


def test_evidence_replaces_older_fetches_and_silent_pages_have_no_facts(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    pages = spark.createDataFrame([(1, "https://a/x", at(5)), (2, "https://a/y", at(6)), (3, "https://a/z", at(7))], "id long, url string, fetched_at timestamp")
    assoc = spark.createDataFrame([(1, "o1", "official-program-subpage"), (2, "o1", "historical-examples-only"), (3, "o2", "explicit-program-identifier")], "page_id long, opportunity_id string, association string")
    facts = spark.createDataFrame([(1, "deadline", "2024-05-01", False), (1, "maximum", "5", False), (2, "deadline", "2020-01-01", False), (3, "maximum", "7", False)], "id long, field string, value string, conflict boolean")
    old = spark.createDataFrame([("o1", "https://a/x", "old", 0, at(9), 9), ("o9", "https://a/q", "old", 8, at(1), 1)], "opportunity_id string, url string, association string, snapshot_id long, fetched_at timestamp, n_facts long")
    kept, rounds, aliases = E.attach_evidence(assoc, pages, facts, old)
    assert sorted((r.opportunity_id, r.url, r.snapshot_id, r.n_facts) for r in kept.collect()) == [("o1", "https://a/x", 1, 2), ("o1", "https://a/y", 2, 0), ("o2", "https://a/z", 3, 1), ("o9", "https://a/q", 8, 1)]
    assert [(r.opportunity_id, r.snapshot_id) for r in rounds.collect()] == [("o1", 1)]
    assert sorted(r.url for r in aliases.collect()) == ["https://a/x", "https://a/z"]
    family = spark.createDataFrame([("o1", "o1"), ("o5", "o1")], "id string, family string")
    more = rounds.unionByName(spark.createDataFrame([("o5", 2, "https://a/y", at(6))], rounds.schema))
    got = sorted((r.family, r.field, r.value) for r in E.round_history(family, more, facts).collect())
    assert got == [("o1", "deadline", "2020-01-01"), ("o1", "deadline", "2024-05-01")]


def test_seed_adds_only_what_is_missing(spark):
    place = "struct<country:string,state:string,city:string>"
    seed = spark.createDataFrame([("a", "A fund", "New", ["Music", "Dance"], [("US", None, None)]), ("b", "B fund", "Old", ["Music"], [("US", None, None), ("CA", "Ontario", None)]), ("a", "A fund", "New", ["Music"], [])], f"slug string, name string, funder string, categories array<string>, places array<{place}>")
    funders, opps = spark.createDataFrame([("Old",)], "name string"), spark.createDataFrame([("b",)], "id string")
    geos = spark.createDataFrame([("b", "US", None, None)], "opportunity_id string, country string, state string, city string")
    out = U.seed_load(seed, funders, opps, geos)
    assert [r.name for r in out["funders"].collect()] == ["New"] and [r.slug for r in out["programs"].collect()] == ["a"]
    assert sorted(r.category for r in out["categories"].collect()) == ["Dance", "Music"]
    assert sorted(tuple(r) for r in out["places"].select("slug", "country").collect()) == [("a", "US"), ("b", "CA")]


def test_public_export_has_no_other_columns(spark):
    opps = spark.createDataFrame([("o1", "n", False, "secret"), ("o2", "m", True, "x")], "id string, name string, is_demo boolean, provenance string")
    out = U.public_export({"opportunities": opps, "saved_opportunities": opps})
    assert list(out) == ["opportunities"] and [(r.id, r.provenance) for r in out["opportunities"].collect()] == [("o1", {"method": "export"})]
    assert "secret" not in str(out["opportunities"].collect())


def test_facts_of_many_wordings(spark):
    texts = {
        1: ("River Fund 2024", "Applications close June 3. Deadline: 2024-05-01. Grants of up to $2.5 million are made.", {("deadline", "2024-05-01", False), ("deadline", "2024-05-01", True), ("maximum", "2500000", False)}),
        2: ("River Fund", "The program is no longer good; previously the program is offered annually. Minimum award: $1,500.50 of funding.", {("minimum", "1500.5", False)}),
        3: ("River Fund", "Grants of up to $5,000 CAD support artists. Deadline: 2024-02-30. Deadline: March 3, 2024.", {("deadline", "2024-03-03", False)}),
        4: ("River Fund", "This grant is a one-time award. The fellowship is awarded every year. Applications were open. Funding for all.", {("recurrence", "one_time", False), ("recurrence", "annual", False)}),
        5: ("Grant directory", "Deadline: 2024-05-01. Funding.", set()),
        6: ("River Fund", "Applications open: March 1, 2024. Applicants must be individual artists or students. It supports art.", {("opens", "2024-03-01", False), ("status", "unknown", True), ("applicants", '["individual","student"]', False), ("eligibility", "Applicants must be individual artists or students.", False)}),
    }
    pages = spark.createDataFrame([(i, f"https://x.org/p/{i}", t, b, dt.datetime(2024, 1, 1)) for i, (t, b, _) in texts.items()], "id long, url string, title string, body string, fetched_at timestamp")
    got = E.text_facts(pages).collect()
    for i, (_, body, want) in texts.items():
        assert {(r.field, r.value, r.conflict) for r in got if r.id == i} == want
        assert all(r.excerpt in body for r in got if r.id == i)
    assert {r.cycle for r in got if r.id == 1} == {"2024"}
    assert E.text_facts(pages.where("false")).count() == 0 and E.text_facts(pages.withColumn("body", F.lit(None).cast("string"))).count() == 0


def test_lifecycle_of_names_with_full_stops(spark):
    rows = [
        ("a", "U.S. Arts Grant", "U.S. Arts Grant – home", "News. U.S. Arts Grant has been discontinued. More."),
        ("b", "U.S. Arts Grant", "U.S. Arts Grant", "The U.S. Arts Grant has been discontinued."),
        ("c", "Rural (Arts) Fund+", "Rural (Arts) Fund+", "Rural (Arts) Fund+ is now accepting applications! Apply."),
        ("d", "Rural Arts Fund", "Rural Arts Fund", "This fund is no longer offered this year. This fund has been discontinued."),
        ("e", "Rural Arts Fund", "Rural Arts Fund", "This fund may resume. The program has reopened"),
        ("f", "Fund", "Fund", "This fund has been discontinued."),
        ("g", "Rural Arts Fund", "Another page", "This fund has been discontinued."),
        ("h", "Rural Arts Fund", None, None),
    ]
    got = {r.id: (r.state, r.evidence) for r in E.lifecycle_signal(spark.createDataFrame(rows, "id string, name string, title string, text string")).collect()}
    assert got == {"a": ("discontinued", "U.S. Arts Grant has been discontinued."), "c": ("active", "Rural (Arts) Fund+ is now accepting applications!"), "e": ("active", "The program has reopened")}


def test_publication_reaches_every_rule(spark):
    from fundcat.plans import registry

    rows = registry.QUERIES["publish_decide"](spark, "/root/testdata/sf0.01").collect()
    reasons = {r.reason.split(":")[0] for r in rows}
    assert len(rows) == 1000 and {r.outcome for r in rows} == {"published", "updated", "skipped"} and any(r.dismissed for r in rows)
    assert reasons >= {
        "Not a pending grant candidate", "Source evidence or approved domain is missing", "A newer source snapshot requires review", "Non-program or unresolved page", "Editor-hidden or merged listing stays unpublished",
        "Program association unresolved; enrichment scheduled", "Official evidence processed with field history and locks", "Likely duplicate program — merge or review the existing listing", "Published unverified grant lead",
    }


def test_worker_throughput_counts_each_url_once_and_meets_few_rows(spark):
    """Against a plain loop: ties with both ends, repeated checks and windows, empty ones."""
    rng = random.Random(5)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    checks = [(f"u{rng.randrange(12)}", at(rng.randrange(600))) for _ in range(400)]
    samples = [(i, at(a), at(a + rng.randrange(-5, 150))) for i in range(120) for a in [rng.randrange(600)]]
    out = U.worker_throughput(spark.createDataFrame(samples, "id long, started timestamp, finished timestamp"), spark.createDataFrame(checks, "url string, at timestamp"))
    want = {i: [u for u, t in checks if a <= t <= b] for i, a, b in samples}
    assert {r.id: (r.checked, r.pages) for r in out.collect()} == {i: (len(set(w)), len(w)) for i, w in want.items()}
