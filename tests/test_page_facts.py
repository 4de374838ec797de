"""Facts, evidence and examples of pages, on HTML as publishers write it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fundcat.operators import page_facts as G
from fundcat.sources.outline import outline, outlines

PAGES = "page_id long, url string, html string"
LONG = "This grant supports community projects that bring neighbours together over many seasons."
WHO = "Residents of the county aged eighteen or more who work in the arts may apply."


def _outlines(spark, *pages):
    return outlines(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], PAGES))


def _facts(spark, *pages):
    return {r.page_id: r for r in G.html_facts(_outlines(spark, *pages)).collect()}


def test_facts_of_sections_and_dates(spark):
    url = "https://example.org/program"
    got = _facts(
        spark,
        (url, f"<nav><p>{LONG}</p></nav><main><h1>T</h1><p>Short grant.</p><p>{LONG}<p>{LONG} Again.<h2>Eligibility</h2><p>{WHO}</p><ul><li>One<li>Two</ul><h3>More</h3><p>no</p>Deadline: 2024-05-01.</main>"),
        (url, f"<main><h2>Eligibility:</h2><div><h4>Who</h4><p>{WHO}</p></div><p>Deadline: 2/30/2024</p></main>"),
        (url, f"<main><dl><dt>Who can apply?<dd>{WHO}<dt>Else<dd>x</dl><p>Deadline: 2024-05-01, or Deadline: 2024-06-01</p></main>"),
        (url, f"<main><h2>Eligibility</h2><p>{WHO}</p><h2>Eligible applicants</h2><p>{WHO} Too.</p>Applications due: 3/7/2024</main>"),
        (url, f"<main><b>Broken <p>{LONG}</b><p>next</main> <h2>Eligibility</h2><p>{WHO} Outside the main text.</p>"),
        (url, None),
        (None, "<p"),
    )
    assert got[0].summary == LONG and got[0].eligibility == f"{WHO} One Two"
    assert (got[0].deadline, got[0].deadline_evidence) == ("2024-05-01", "Deadline: 2024-05-01")
    assert got[1].eligibility == f"Who {WHO} Deadline: 2/30/2024" and got[1].deadline is None and got[1].deadline_evidence is None
    assert got[2].eligibility == WHO and got[2].deadline is None
    assert got[3].eligibility is None and got[3].deadline == "2024-03-07"
    assert got[4].summary == LONG and got[4].eligibility is None
    assert all(v is None for k, v in got[5].asDict().items() if k not in ("page_id", "url", "text"))
    assert got[6].url is None and got[6].summary is None


def test_facts_of_the_adapter(spark):
    url = "https://www.spencer.org/grant_types/small"
    page = lambda x: f"<main><h1>Small Grants</h1><p>{LONG}</p><h2>Eligibility</h2><p>{WHO}</p><p>{x}</p></main>"
    got = _facts(
        spark,
        (url, page("Application Deadline: April 9, 2024. Budgets up to $50,000. Applications are open.")),
        (url, page("Deadline: April 31, 2024. Budgets up to $50,000, and budgets up to $75,000. Applications Open: Now closed.")),
        (url, page("Deadline: April 9, 2024. Deadline: 2024-04-10. Applications are open. Applications are closed.")),
        ("https://example.org/grant_types/small", page("Deadline: April 9, 2024. Budgets up to $50,000. Applications are open.")),
        (url, page("Deadline: 2024-04-10. Budgets up to $0. Applications currently closed")),
    )
    assert (got[0].deadline, got[0].maximum, got[0].currency, got[0].status, got[0].official_adapter) == ("2024-04-09", "50000", "USD", "open", "spencer-program-v1")
    assert (got[0].amount_evidence, got[0].status_evidence) == ("Budgets up to $50,000", "Applications are open.")
    assert (got[1].deadline, got[1].maximum, got[1].status, got[1].status_evidence) == (None, None, "closed", "Applications Open: Now closed.")
    assert (got[2].deadline, got[2].status) == (None, None)
    assert (got[3].deadline, got[3].maximum, got[3].status, got[3].official_adapter) == (None, None, None, None)
    assert (got[4].deadline, got[4].maximum, got[4].status) == ("2024-04-10", None, "closed")
    claims = G.html_facts(_outlines(spark, (url, page("Application Deadline: April 9, 2024. Budgets up to $50,000. Applications are open.")))).withColumnsRenamed({"page_id": "id", "text": "body"})
    row = G.evidence_check(claims, "2024-01-31").first()
    assert row.auto_verified and row.deadline == dt.date(2024, 4, 9) and row.maximum == 50_000 and len(row.spans) == 5
    assert not G.evidence_check(claims, "2024-04-10").first().auto_verified


def test_excerpts_are_proven_at_a_place(spark):
    body = "  Funds\n\n for   the river.  (a+b)? \\E ok\tFunds for the river."
    rows = [(body, "Funds for the river."), (body, "(a+b)? \\E ok"), (body, "funds for the river."), (body, ""), (None, "x"), (body, None), (body, "for the  river.\n(a+b)?")]
    got = [r.s for r in spark.createDataFrame(rows, "t string, e string").select(G.excerpt_span(F.col("t"), F.col("e")).alias("s")).collect()]
    fold = lambda t: " ".join(t.split())
    assert [s and fold(body[s.start : s.end]) for s in got] == ["Funds for the river.", "(a+b)? \\E ok", None, None, None, None, "for the river. (a+b)?"]
    assert got[0].start == 2


def test_claims_without_an_excerpt_say_nothing(spark):
    columns = "id long, url string, body string, summary string, eligibility string, status string, status_evidence string, maximum string, currency string, amount_evidence string, deadline string, deadline_evidence string, official_adapter string"
    body = "A summary of twelve letters. Applications are open. Budgets up to $5. Deadline: 2024-05-01."
    rows = [
        (1, "https://x.org/", body, "A summary of twelve letters.", "Who may apply to it", "open", "Applications are open.", "5", "USD", "Budgets up to $5.", "2024-05-01", "Deadline: 2024-05-01", None),
        (2, "https://x.org/", body, "A summary", None, "paused", "Applications are open.", "500000000", "USD", "Budgets up to $5.", "2024-02-30", "Deadline: 2024-05-01", None),
        (3, None, None, "A summary of twelve letters.", None, None, None, "5", "EUR", "Budgets up to $5.", None, None, None),
    ]
    got = {r.id: r for r in G.evidence_check(spark.createDataFrame(rows, columns)).collect()}
    assert (got[1].summary, got[1].eligibility, got[1].status, got[1].maximum, got[1].deadline) == (rows[0][3], None, "open", 5, dt.date(2024, 5, 1)) and not got[1].auto_verified
    assert [s.field for s in got[1].spans] == ["summary", "status", "maximum", "deadline"]
    assert (got[2].summary, got[2].status, got[2].maximum, got[2].deadline, got[2].spans) == (None, "unknown", None, None, [])
    assert (got[3].summary, got[3].status, got[3].spans) == (None, "unknown", [])


NAME, SOURCE = "Harbor Arts Grant", "https://example.org/harbor"
CARDS = f"""<main><h1>{NAME}</h1><section><h2>Past recipients</h2><article><h3>Tidal Songs</h3><a href='/projects/tidal'>Tidal Songs</a><p>{NAME} recipient in 2023, a choir by the sea.</p><img src='/i/tidal.jpg' alt='The choir'></article>
 <article><h3>Lamp Walk</h3><a href='/projects/lamp?utm_source=x'>Read more</a><p>A grantee of 2022 who lit the whole long quay with lamps made of paper and wood and glass and tin found on the beach there</p><img src='https://elsewhere.org/lamp.jpg'></article></section>
 <p><a href='/s/proposal.pdf'>Sample application</a> for the {NAME}.</p><p><a href='/guide.pdf'>Application guidelines</a> example proposal</p><p><a href='/form.pdf'>Blank application template</a> sample application</p>
 <ul><li><a href='/r'>View all recipients</a></li><li>This was not funded: <a href='/n'>A rejected proposal sample</a></li><li><a href='https://127.0.0.1/x'>Private grant recipient</a></li></ul></main>"""


def test_examples_of_cards(spark):
    pages = [(SOURCE, CARDS), ("https://example.org/tidal", f"<main><h1>Tidal Songs</h1><p>Tidal Songs was funded by the {NAME} in 2021.</p><figure><img src='/i/logo.png'><figcaption>At sea</figcaption></figure></main>"), ("https://example.org/no", f"<main><h1>No</h1><p>This proposal was not funded by the {NAME}.</p></main>"), ("https://example.org/r", f"<main><h1>Past recipients</h1><p>{NAME} recipients in 2024.</p></main>")]
    got = G.example_extract(_outlines(spark, *pages)).cache()
    cards = {r.url: r for r in got.where("page_id = 0 and not own").collect()}
    assert set(cards) == {"https://example.org/projects/tidal", "https://example.org/projects/lamp", "https://example.org/s/proposal.pdf"}
    tidal, lamp = cards["https://example.org/projects/tidal"], cards["https://example.org/projects/lamp"]
    assert (tidal.kind, tidal.title, tidal.year, tidal.image, tidal.alt) == ("funded_project", "Tidal Songs", "2023", "https://example.org/i/tidal.jpg", "The choir")
    assert (lamp.title, lamp.image, len(lamp.excerpt.split())) == ("Lamp Walk", None, 22)
    assert cards["https://example.org/s/proposal.pdf"].kind == "sample_application"
    own = [(r.page_id, r.title, r.year, r.image) for r in got.where("own and page_id > 0").collect()]
    assert own == [(1, "Tidal Songs", "2021", None)]
    programs = spark.createDataFrame([("a", NAME, SOURCE), ("b", "Other Foundation Grant", "https://o.org/"), ("c", "arbor Arts Grant", "https://c.org/")], "id string, name string, source_url string")
    attached = G.example_attach(got, programs, spark.createDataFrame([(0, "a")], "page_id long, id string"))
    urls = {}
    for r in sorted(attached.collect(), key=lambda r: (r.page_id, r.n)):
        urls.setdefault((r.id, r.page_id), []).append(r.url)
    assert urls["a", 0] == ["https://example.org/projects/tidal", "https://example.org/projects/lamp", "https://example.org/s/proposal.pdf"] and urls["a", 1] == ["https://example.org/tidal"]
    assert urls["c", 0] == ["https://example.org/harbor", "https://example.org/projects/tidal", "https://example.org/s/proposal.pdf"] and not any(k[0] == "b" for k in urls)
    at = lambda d: dt.datetime(2024, 1, d)
    newest = G.family_examples(attached.where("id = 'a'"), spark.createDataFrame([("a", "z")], "id string, family string"), spark.createDataFrame([(0, at(1)), (1, at(9))], "page_id long, fetched_at timestamp"))
    assert [r.url for r in sorted(newest.collect(), key=lambda r: r.place)] == ["https://example.org/tidal", *urls["a", 0]]


def test_names_are_found_as_by_a_nested_loop(spark):
    rng = random.Random(3)
    words = ["art", "rural", "harbor", "of", "the", "fund", "community", "x", "film"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["communityart", "mmunityart", "harbor fund", "arbor fund"]
    texts = ["".join(rng.choice(words) + rng.choice((" ", " ", "")) for _ in range(rng.randrange(1, 40))).strip() for _ in range(200)]
    cards = spark.createDataFrame([(i, 0, t.upper()) for i, t in enumerate(texts)], "page_id long, place int, context string")
    programs = spark.createDataFrame([(str(i), f" {n.title()}  ") for i, n in enumerate(names)], "id string, name string")
    got = {(r.page_id, r.id) for r in G._named(cards, programs).collect()}
    want = {(i, str(j)) for i, t in enumerate(texts) for j, n in enumerate(names) if len(n) >= 10 and n in t}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("html", ["<div>" * 30_000, "<p>" * 3000 + "<a href='x'>" * 3000, "</p></div><b><i></b></i><table><tr><td>a<td>b</table>", "<main><h2>Eligibility", "\x00<!doctype><![CDATA[x]]>"])
def test_outlines_of_broken_pages(html):
    title, text, paragraphs, sections, cards, own = outline("https://example.org/", html)
    assert len(cards) <= 3000 and own[0] == -1
