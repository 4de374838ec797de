"""Reconciliation in rounds against going through the pages one by one."""

import datetime as dt
import random

import pytest

from fundcat.operators import reconcile as R

ITEMS = "item_id string, ord long, opportunity_id string, candidate_id string, item_url string, page_url string, title string, body string"
PROGRAMS = "id string, name string, source_url string, verified boolean, created_at timestamp, origin string, method string, publication_state string, fresh boolean"
AT = dt.datetime(2024, 1, 1)
BODY = "Apply for funding. This program supports rural artists and provides grants to applicants."
TITLES = {"Rural Arts Fund": "program", "FAQ for applicants": "faq", "Grant guidelines": "guidelines", "Grants": "directory", "Contact us": "ambiguous"}


def identity(url):
    head, _, query = url.removeprefix("https://").removeprefix("www.").partition("?")
    host, _, path = head.partition("/")
    if host == "nyfa.org" and "opportunity-info" in path and query.startswith("id="):
        return host + ":" + query[3:]
    return f"https://{host}/" + path.rstrip("/") + (f"?{query}" if query else "")


def host_path(url):
    host, _, path = url.removeprefix("https://").removeprefix("www.").partition("?")[0].partition("/")
    return host, ("/" + path).rstrip("/")


def related(program, page, role):
    if identity(program["url"]) == identity(page):
        return "explicit-program-identifier"
    (a, parent), (b, path) = host_path(program["url"]), host_path(page)
    if a == b and role in ("application", "guidelines", "faq", "supporting") and parent and path.startswith(parent + "/"):
        return "official-program-subpage"
    return None


def one_by_one(items, programs, aliases):
    live = {p[0]: dict(zip(("id", "name", "url", "verified", "created", "origin", "method", "state", "fresh"), p, strict=True)) for p in programs}
    rank = lambda p: (not p["verified"], p["created"], p["id"])
    out = {}
    for item, _, own, candidate, item_url, page, title, _ in sorted(items, key=lambda r: r[1]):
        role = TITLES[title]
        if item_url != page and identity(item_url) != identity(page):
            out[item] = ("identity-review", None, None)
            continue
        g = live.get(own)
        if g and candidate and not related(g, page, role) and identity(g["url"]) != identity(page) and (own, page) not in aliases:
            g = None
        targets = [p for p in live.values() if p is not g and p["state"] == "published" and related(p, page, role)]
        t = min(targets, key=rank, default=None)
        named = g and TITLES.get(g["name"]) == "program"
        aside = role in R.NO_PROGRAM
        if t and g and rank(g) < rank(t) and (role == "program" or g["verified"] or named):
            out[item] = ("merged", g["id"], t["id"]) if t["fresh"] else ("duplicate-review", g["id"], t["id"])
            if t["fresh"]:
                del live[t["id"]]
        elif t and g and g["state"] != "hidden":
            out[item] = ("merged", t["id"], g["id"])
            del live[g["id"]]
        elif t:
            out[item] = ("attached", t["id"], None)
        elif aside and g and (g["verified"] or g["origin"] != "crawler" or g["method"] == "official-structured-data" or named):
            out[item] = ("source-review", g["id"], None)
        elif aside and g and g["state"] == "published":
            out[item] = ("hidden", g["id"], None)
            g["state"] = "hidden"
        elif aside:
            out[item] = ("excluded", None, None)
        elif not g and candidate and role == "program":
            new = {"id": f"new-{item}", "name": title, "url": page, "verified": False, "created": dt.datetime(2024, 1, 31), "origin": "crawler", "method": None, "state": "published", "fresh": True}
            live[new["id"]] = new
            out[item] = ("published", new["id"], None)
        else:
            out[item] = ("kept", g["id"], None) if g else ("ambiguous", None, None)
    return out


def graph(seed, n_items, n_urls):
    rng = random.Random(seed)
    urls = [f"https://{rng.choice(('a.org', 'www.a.org', 'b.org'))}/p{i % n_urls}" for i in range(n_urls)] + [f"https://a.org/p{i}/x" for i in range(n_urls)] + ["https://nyfa.org/opportunity-info?id=1", "https://www.nyfa.org/opportunity-info/?id=1", "https://nyfa.org/opportunity-info?id=2"]
    programs = [(f"o{i:03d}", rng.choice(("Rural Arts Fund", "Grants", "Contact us")), rng.choice(urls), rng.random() < 0.3, AT + dt.timedelta(days=rng.randrange(5)), rng.choice(("crawler", "crawler", "editor")), rng.choice((None, "official-structured-data", "x")), rng.choice(("published",) * 4 + ("hidden",)), rng.random() < 0.7) for i in range(n_items // 2)]
    items = []
    for i in range(n_items):
        own = rng.choice(programs) if rng.random() < 0.6 else None
        url = own[2] if own and rng.random() < 0.7 else rng.choice(urls)
        page = url if rng.random() < 0.9 else rng.choice(urls)
        page = page + rng.choice(("", "", "/s1", "/x/y")) if "?" not in page and rng.random() < 0.5 else page
        items.append((f"i{i}", i * 7919 % 10007, own and own[0], f"c{i}" if not own or rng.random() < 0.3 else None, page if rng.random() < 0.9 else url, page, rng.choice(list(TITLES)), BODY))
    aliases = [(rng.choice(programs)[0], rng.choice(urls)) for _ in range(5)]
    return items, programs, aliases


@pytest.mark.parametrize(("seed", "n_items", "n_urls"), [(1, 60, 6), (2, 200, 40)])
def test_rounds_decide_as_one_by_one(spark, seed, n_items, n_urls):
    items, programs, aliases = graph(seed, n_items, n_urls)
    rows = R.reconcile_decide(spark.createDataFrame(items, ITEMS), spark.createDataFrame(programs, PROGRAMS), spark.createDataFrame(aliases, "opportunity_id string, url string"), "2024-01-31").collect()
    assert {r.item_id: (r.outcome, r.program, r.other) for r in rows} == one_by_one(items, programs, set(aliases))
    assert len(rows) == len(items)
    print(seed, max(r.round for r in rows), sorted({r.outcome for r in rows}))


def test_every_outcome_is_reached(spark):
    seen = set()
    for seed in range(40):
        seen |= {v[0] for v in one_by_one(*graph(seed, 60, 6)).values()}
    assert seen == {"identity-review", "merged", "duplicate-review", "attached", "source-review", "hidden", "excluded", "published", "kept", "ambiguous"}


def test_hot_program_with_readers_takes_few_rounds(spark):
    programs = [("o0", "Rural Arts Fund", "https://a.org/p", True, AT, "editor", None, "published", True)] + [(f"o{i}", "Grants", f"https://a.org/p/x{i}", False, AT, "crawler", None, "published", True) for i in range(1, 40)]
    items = [(f"i{i}", i, f"o{i}" if i % 2 else None, None if i % 2 else f"c{i}", f"https://a.org/p/x{i}", f"https://a.org/p/x{i}", "FAQ for applicants", BODY) for i in range(1, 40)]
    rows = R.reconcile_decide(spark.createDataFrame(items, ITEMS), spark.createDataFrame(programs, PROGRAMS), spark.createDataFrame([], "opportunity_id string, url string"), "2024-01-31").collect()
    assert {r.item_id: (r.outcome, r.program, r.other) for r in rows} == one_by_one(items, programs, set())
    assert max(r.round for r in rows) <= 2 and sum(r.outcome == "merged" for r in rows) > 10


def test_empty_inventory(spark):
    empty = spark.createDataFrame([], ITEMS)
    assert R.reconcile_decide(empty, spark.createDataFrame([], PROGRAMS), spark.createDataFrame([], "opportunity_id string, url string")).collect() == []
