"""Drafts and reviews: branches, repeats and a set applied twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundcat.fixtures import Catalog
from fundcat.operators import editorial as D

TASKS = "draft_id long, n long, title string, notes string, due_date string, source_url string, source_excerpt string, uncertainty string, date_excerpt string"
URL = "https://a.org/x"
SOURCE = "Send  the form\nby 3 March, 2024 or Sept. 4th 2024. A budget is due 1/2/2025."


def test_dates_are_supported_as_written(spark):
    rows = [("2024-03-03", "by 3 March, 2024", True), ("2024-03-03", "March 03 2024", True), ("2024-03-13", "by 3 March, 2024", False), ("2024-09-04", "Sept. 4th 2024", False), ("2024-09-04", "Sep. 4th, 2024", True), ("2025-01-02", "1/2/2025", True), ("2025-01-02", "01/02/2025", True), ("2025-01-02", "11/2/2025", False), ("2024-05-06", "on 2024-05-06", True), ("2024-13-06", "6 March 2024", False), ("soon", "soon", False), (None, "x", False)]
    got = spark.createDataFrame(rows, "day string, excerpt string, want boolean").select("*", D.supports_date(F.col("day"), F.col("excerpt")).alias("got")).collect()
    assert [r.day for r in got if r.got != r.want] == []


def test_one_ungrounded_task_rejects_its_draft(spark):
    rows = [
        (1, 0, "Form", "", "2024-03-03", URL, "Send the form by", "", "by 3 March, 2024"),
        (1, 1, "Budget", "", "2025-01-03", URL, "A budget is\tdue", "Which?", "due 1/2/2025"),
        (2, 0, "Form", "", None, URL, "Send the form by", "", ""),
        (2, 1, "Form", "", None, URL, "Send the forms by", "", ""),
        (3, 0, "Form", "", None, "https://b.org/", "Send the form by", "", ""),
        (4, 0, "x" * 201, "", None, URL, "Send the form by", "", ""),
        (5, 0, "Form", None, None, URL, None, None, None),
        (6, 0, "Form", "", "2024-03-03", URL, "Send the form by", None, None),
    ] + [(7, i, "Form", "", None, URL, "Send the form by", "", "") for i in range(41)]
    drafts, tasks = D.draft_validate(spark.createDataFrame(rows, TASKS), spark.createDataFrame([(URL, SOURCE)], "url string, text string"))
    assert {r.draft_id: (r.outcome, r.reason) for r in drafts.collect()} == {1: ("kept", None), 2: ("rejected", "unsupported task"), 3: ("rejected", "unsupported task"), 4: ("rejected", "malformed"), 5: ("rejected", "malformed"), 6: ("kept", None), 7: ("rejected", "malformed")}
    got = {(r.draft_id, r.n): (r.due_date, r.uncertainty) for r in tasks.collect()}
    assert got == {(1, 0): ("2024-03-03", ""), (1, 1): (None, f"Which? {D.NO_DATE}"), (6, 0): (None, D.NO_DATE)}


REVIEWS = "review_id string, id string, base_version timestamp, name string, funder string, url string, summary string, eligibility string, notes string, evidence string, status string, minimum double, maximum double, fee double, deadline date, opens date, rolling boolean, currency string, categories array<string>, applicants array<string>, locations string, archive boolean, reviewed_at timestamp"
AT = dt.datetime(2024, 1, 30)


def review(n, **changes):
    row = {
        "review_id": f"r{n}", "id": f"o{n}", "base_version": None, "name": f"A reviewed program {n}", "funder": "Some Funder", "url": f"https://reviewed.org/{n}", "summary": "A summary that is long enough.", "eligibility": "Everyone in the town may apply.", "notes": "Checked today.",
        "evidence": "The official page says so in its first paragraph.", "status": "open", "minimum": 1.0, "maximum": 2.0, "fee": None, "deadline": dt.date(2024, 5, 1), "opens": None, "rolling": None, "currency": "USD", "categories": ["Music"], "applicants": ["nonprofit"], "locations": "Worldwide", "archive": False, "reviewed_at": AT,
    }
    return tuple((row | changes).values())


@pytest.fixture(scope="module")
def tables(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    return {
        "opportunities": c["opportunities"], "funders": c["funders"], "categories": c["opportunity_categories"], "applicants": c["opportunity_applicant_types"], "geographies": c["opportunity_geographies"],
        "monitoring": c["catalog_monitoring"], "applied": spark.createDataFrame([], "review_id string"),
    }


def test_reviews_in_every_case(spark, tables):
    other = tables["opportunities"].where("id = 'o3'").first()
    current = tables["opportunities"].where("id = 'o25'").first().catalog_updated_at
    rows = [
        review(1, archive=True, locations="Canada | Ontario\nWorldwide"), review(2, name="ab"), review(4, name=other.name.upper() + "!"), review(5, url=other.source_url), review(6, base_version=dt.datetime(2020, 1, 1)), review(7, id="nobody"),
        review(8, id="", url="https://new.org/a"), review(9, id=None, url="https://new.org/a", name="Another name", reviewed_at=AT + dt.timedelta(hours=1)), review(10, id="", name="A reviewed program 11"), review(11, reviewed_at=AT + dt.timedelta(hours=1)), review(25, base_version=current), review(27, id="o25", base_version=current, reviewed_at=AT + dt.timedelta(hours=1)),
        review(14, categories=["Nothing"]), review(15, locations="a|b|c|d"), review(16, status="upcoming"), review(17, minimum=3.0), review(18, currency=None, applicants=[]), review(19, deadline=dt.date(2024, 1, 1)),
    ]
    df = spark.createDataFrame(rows, REVIEWS)
    out = D.review_apply(df, tables, "2024-01-31")
    got = {r.review_id: r for r in out["outcomes"].collect()}
    assert {k: v.outcome for k, v in got.items() if v.outcome != "rejected"} == {"r1": "applied", "r4": "duplicate", "r5": "duplicate", "r6": "stale", "r7": "not found", "r8": "applied", "r9": "duplicate", "r10": "applied", "r11": "duplicate", "r25": "applied", "r27": "stale"}
    assert {k: v.violations for k, v in got.items() if v.outcome == "rejected"} == {"r2": ["name"], "r14": ["categories"], "r15": ["locations"], "r16": ["upcoming needs opening"], "r17": ["minimum exceeds maximum"], "r18": ["currency", "applicants"], "r19": ["passed deadline"]}
    programs = {r.id: r for r in out["opportunities"].where("id in ('o1', 'o6', 'o25') or id like 'review-%'").collect()}
    assert (programs["o1"].publication_state, programs["o1"].verification_status, programs["o25"].name) == ("hidden", "archived", "A reviewed program 25") and programs["o6"].name != "A reviewed program 6" and len(programs) == 5
    assert out["opportunities"].count() == tables["opportunities"].count() + 2 and out["funders"].where("name = 'Some Funder'").count() == 1
    assert sorted((r.country, r.state, r.city) for r in out["geographies"].where("opportunity_id = 'o1'").collect() if r.country) == [("Canada", "Ontario", None)] and out["geographies"].where("opportunity_id = 'o1'").count() == 2
    assert [r.category for r in out["categories"].where("opportunity_id = 'o25'").collect()] == ["Music"]
    again = D.review_apply(df, tables | {k: v for k, v in out.items() if k != "outcomes" and k != "monitoring"}, "2024-02-01")
    assert {r.outcome for r in again["outcomes"].where("review_id in ('r1', 'r8', 'r10', 'r25')").collect()} == {"repeated"}
    for name in ("opportunities", "funders", "categories", "applicants", "geographies"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, out[name].collect())), name


def test_no_reviews_change_nothing(spark, tables):
    out = D.review_apply(spark.createDataFrame([], REVIEWS), tables)
    assert out["outcomes"].count() == 0 and sorted(map(str, out["opportunities"].collect())) == sorted(map(str, tables["opportunities"].collect()))
