"""Plans that grow no faster than their tables."""

from __future__ import annotations

from conftest import SMALL
from pyspark.sql import functions as F

from fundcat.operators import evidence as E


def test_text_facts_searches_pages_where_they_are_dealt_to(spark):
    body = "This grant supports music!\nAPPLICATIONS are open now. Last year applications are closed?Applications are\nopen. So: the grant is offered annually. Never more.\nthe program runs monthly. Grants of up to $5,000."
    pages = spark.createDataFrame([(1, "https://a.example.org/p", "River Music Fund", body, "2024-01-01"), (2, "https://a.example.org/q", "River Music Fund", None, None)], "id int, url string, title string, body string, fetched_at string").coalesce(1)
    facts = E.text_facts(pages)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan[plan.lower().index("repartitionbyexpression") :].lower()  # nothing is searched by the task that reads
    got = sorted((r.field, r.value, r.excerpt) for r in facts.collect())
    assert got == [
        ("maximum", "5000", "Grants of up to $5,000"),
        ("recurrence", "annual", "the grant is offered annually"),
        ("recurrence", "recurring", "the program runs monthly"),
        ("status", "open", "APPLICATIONS are open now."),
    ]


def test_programs_alike_are_judged_once(spark):
    from fundcat.operators import catalog as C

    rows = [(f"o{i}", f"Fund {i:02}", "Music for all", "open", None, 5.0 + i, ["Music"], ["nonprofit"] if i < 30 else []) for i in range(40)]
    wide = spark.createDataFrame(rows, "id string, name string, summary string, status string, current_deadline date, maximum_award double, categories array<string>, applicants array<string>")
    geos = spark.createDataFrame([(f"o{i}", 0, "Canada", None, None, "eligible") for i in range(20)], "opportunity_id string, seq int, country string, state string, city string, rule string")
    profiles = spark.createDataFrame([(f"w{i}", "nonprofit", "Canada", None, None) for i in range(5)] + [("x", "student", None, None, None)], "workspace_id string, applicant_type string, country string, state string, city string")
    members = C.profile_classes(profiles, spark.createDataFrame([(f"w{i}", "Music") for i in range(5)] + [("x", "Music")], "workspace_id string, category string"))
    kinds = C.program_kinds(wide, geos, "fund 07")
    verdicts = C.kind_match(kinds, members, geos)
    assert verdicts.count() == 6  # two classes, three kinds
    each = C.class_match(wide, members, geos, "fund 07")
    assert each.count() == 80
    # A ranking needs the first rows of each kind alone, and the totals need no rows.
    ranked = lambda m: sorted(map(tuple, C.rank_results(m, members, 4).select("workspace_id", "rank", "id", "matches", "conflicts", "relevance").collect()))
    few = C.class_match(wide, members, geos, "fund 07", top=4)
    assert few.count() == 24 and ranked(few) == ranked(each) and ranked(few)[0] == ("w0", 1, "o7", 3, 0, 6)
    totals = C.profile_totals(kinds, verdicts, members).agg({"n": "sum"}).first()[0]
    assert totals == 240 == C.profile_match(wide, profiles, members.selectExpr("workspace_id", "explode(wanted) as category"), geos).count()


def test_status_is_looked_for_near_its_words(spark):
    long = "so they said " * 400
    texts = ["Applications are open", f"{long}APPLICATIONS are now{long}applications are currently not being accepted {long}", f"{'x' * 64} applications closed{'y ' * 90}", "İ" * 90 + " applications open for all!", f"applications went {long}, applications are closed {'z' * 99}{long}."]
    got = spark.createDataFrame([(t,) for t in texts], "body string").select("body", E._near_applications(F.col("body")).alias("near"))
    find = lambda c: F.regexp_extract_all(c, F.lit(E.ascii_words(E.STATUS)), F.lit(0))
    rows = got.select("near", find(F.col("body")).alias("a"), find(F.col("near")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a) for r in rows) == 4
    assert len(rows[4].near) < len(texts[4]) - 5000


def test_related_pages_decides_a_role_once(spark):
    pages = spark.createDataFrame([(1, "https://a.example.org/p/faq", "FAQ", "River Music Fund"), (2, "https://a.example.org/p", "Fund", None), (3, "https://a.example.org/q", "Guidelines", "The river music fund"), (4, None, "FAQ", "River Music Fund")], "id int, url string, title string, body string")
    programs = spark.createDataFrame([("o1", "River Music Fund", "https://www.a.example.org/p/")], "id string, name string, source_url string")
    links = spark.createDataFrame([("https://www.a.example.org/p/", "https://a.example.org/q"), ("https://www.a.example.org/p/", "https://a.example.org/p/faq")], "url string, link string")
    related = E.related_pages(pages, programs, links)
    assert related._jdf.queryExecution().optimizedPlan().toString().count("manage-a-grant") == 1
    assert sorted(map(tuple, related.collect())) == [(1, "o1", "official-program-subpage"), (2, "o1", "explicit-program-identifier"), (3, "o1", "official-program-link")]


def test_rounds_keep_programs_in_reach(spark):
    from fundcat.operators import reconcile as R

    live = spark.createDataFrame([("o1", "a", ["is x"]), ("o2", "b", ["is y"]), ("o3", "c", ["below z"]), ("o4", "d", ["is w"]), ("o5", None, [])], "id string, place string, keys array<string>")
    todo = spark.createDataFrame([("o1", ["is n", "below z"], ["b"]), (None, ["is x"], ["e"])], "own string, keys array<string>, places array<string>")
    assert sorted(r.id for r in R._within_reach(live, todo).collect()) == ["o1", "o2", "o3"]


def test_search_reads_texts_once(spark):
    from fundcat.fixtures import Catalog
    from fundcat.operators import search as S
    from fundcat.plans.search import WHO, _results

    c = Catalog(spark, SMALL)
    page = S.unified_search(c, _results(c), WHO, "fund")
    assert not [f for f in page.inputFiles() if "/documents.parquet" in f]
    assert page.count() == 12


def test_rules_are_listed_under_the_masks_that_places_have(spark):
    from fundcat.operators import catalog as C

    geos = spark.createDataFrame([("o1", 0, "Canada", None, None, "eligible"), ("o2", 0, "France", None, None, "eligible"), ("o3", 0, "CANADA", "Ontario", None, "eligible")], "opportunity_id string, seq int, country string, state string, city string, rule string")
    targets = spark.createDataFrame([("t", "Canada", None, None)], "target_id string, country string, state string, city string")
    pairs = spark.createDataFrame([("t", f"o{i}") for i in (1, 2, 3)], "target_id string, opportunity_id string")
    got = C.geo_match(pairs, geos, targets)
    assert "to_json" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, got.select("opportunity_id", "geo").collect())) == [("o1", "eligible"), ("o2", "excluded"), ("o3", "unknown")]


def _made_last(df):
    """Rows are made of blocks above all joins, and nothing above them is shuffled."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join Inner")]
    return "Generate" in top and not any(x in top for x in ("Aggregate", "Repartition", "Sort", "Window"))


def test_suggested_programs_are_not_shuffled_for_each_profile(spark):
    from fundcat.operators import catalog as C

    wide = spark.range(2000).selectExpr("concat('o', id) as id", "'open' as status", "array('Dance', 'Music') as categories", "array('nonprofit') as applicants")
    geos = wide.selectExpr("id as opportunity_id", "'Canada' as country", "cast(null as string) as state", "cast(null as string) as city", "'eligible' as rule")
    profiles = spark.range(100).selectExpr("concat('w', id) as workspace_id", "'nonprofit' as applicant_type", "'canada' as country", "'Ontario' as state", "concat('c', id) as city")
    interests = profiles.selectExpr("workspace_id", "explode(array('Dance', 'Music')) as category")
    got = C.suggested_filter(wide, profiles, interests, geos)
    assert _made_last(got) and got.count() == 200_000 == got.distinct().count()


def test_suggested_programs_as_by_a_plain_loop(spark, monkeypatch):
    import random

    from fundcat.operators import catalog as C

    monkeypatch.setattr(C, "LARGE", 20)  # groups are numbered in parts
    rng = random.Random(5)
    place = lambda: (rng.choice([None, "Canada", "CANADA", "France"]), rng.choice([None, None, "Ontario"]), rng.choice([None, None, "Oslo"]))
    some = lambda *of: sorted(rng.sample(of, rng.randrange(len(of))))
    wide = [(f"o{i}", rng.choice(["open", "upcoming", "closed"]), some("a", "b", "c"), some("x", "y", "z")) for i in range(300)]
    geos = [(f"o{rng.randrange(300)}", *place(), rng.choice(["eligible", "eligible", "excluded"])) for _ in range(400)]
    profiles = [(f"w{i}", rng.choice(["x", "y", None]), *place()) for i in range(300)]
    wants = [(f"w{i}", c) for i in range(290) for c in some("a", "b", "d")]
    alike = lambda rule, own: all(r is None or (o is not None and r.lower() == o.lower()) for r, o in zip(rule, own, strict=True))
    want = set()
    for w, kind, *own in profiles:
        for i, status, cats, kinds in wide:
            if status != "closed" and kind in kinds and any((w, c) in wants for c in cats) and any(g[0] == i and g[4] == "eligible" and alike(g[1:4], own) for g in geos):
                want.add((w, i))
    spots = "country string, state string, city string"
    got = C.suggested_filter(spark.createDataFrame(wide, "id string, status string, categories array<string>, applicants array<string>"), spark.createDataFrame(profiles, f"workspace_id string, applicant_type string, {spots}"), spark.createDataFrame(wants, "workspace_id string, category string"), spark.createDataFrame(geos, f"opportunity_id string, {spots}, rule string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) > 500 and set(rows) == want


def test_target_matches_are_made_last(spark):
    from fundcat.operators import publication as U

    cards = spark.range(400).selectExpr("concat('o', id) as id", "concat('music grant ', id) as said", "if(id % 2 = 0, 'open', 'unknown') as status", "array('Dance', 'Music') as categories", "id % 3 > 0 as known_categories", "array('nonprofit') as applicants", "cast(id as double) as maximum_award", "timestamp '2024-01-31' as checked", "timestamp '2024-01-31' as created_at", "cast(null as timestamp) as catalog_updated_at")
    geos = cards.selectExpr("id as opportunity_id", "'Canada' as country", "cast(null as string) as state", "cast(null as string) as city", "'eligible' as rule")
    jobs = spark.range(900).selectExpr("id as job_id", "'Grant usic' as q", "array('Music', 'Dance') as categories", "cast(array() as array<string>) as focus", "'nonprofit' as applicant", "if(id < 600, 0D, 200D) as min_award", "'' as freshness", "'CANADA' as country", "'Ontario' as state", "if(id % 2 = 0, 'Toronto', null) as city")
    got = U.target_match(jobs, cards, geos, "2024-01-31")
    assert _made_last(got)
    rows = got.selectExpr("count(*)", "count(distinct job_id, id)", "count_if(strict)").first()
    assert tuple(rows) == (300_000, 300_000, sum(i % 3 > 0 for i in range(400)) * 600 + sum(i % 3 > 0 for i in range(200, 400)) * 300)


def test_place_verdicts_as_by_geo_match(spark):
    import random

    from fundcat.operators import catalog as C

    rng = random.Random(3)
    place = lambda: (rng.choice([None, "", "Canada", "CANADA", "France", "Worldwide"]), rng.choice([None, "", "Ontario", "ontario", "Texas"]), rng.choice([None, None, "Oslo", "Austin"]))
    spots = "country string, state string, city string"
    geos = spark.createDataFrame([(f"o{rng.randrange(200)}", *place(), rng.choice(["eligible", "eligible", "excluded", None])) for _ in range(400)], f"opportunity_id string, {spots}, rule string")
    targets = spark.createDataFrame([(f"t{i}", *place()) for i in range(40)], f"target_id string, {spots}")
    pairs = spark.range(210).selectExpr("concat('o', id) as opportunity_id").join(targets.select("target_id"))
    want = {(r.target_id, r.opportunity_id): r.geo for r in C.geo_match(pairs, geos, targets).collect()}
    rules = C.place_rules(geos)
    rows = pairs.join(targets, "target_id").join(rules.withColumnRenamed("id", "opportunity_id"), "opportunity_id", "left")
    own = F.struct(*[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in C.PLACE])
    none = F.array().cast(rules.schema["rules"].dataType)
    got = {(r.target_id, r.opportunity_id): r.geo for r in rows.withColumn("own", own).withColumn("geo", C.place_verdict(F.coalesce("rules", none), F.col("own"))).collect()}
    assert got == want and set(want.values()) == {"eligible", "excluded", "unknown"}
