"""What happens to candidates, feed records, merges and suggestions.

Every job gives the rows that change, or the whole table after the change, and is a plan of
joins and aggregates: a key that many rows share is aggregated before it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.functions import roles as P
from fundcat.functions.places import source_scope
from fundcat.operators.catalog import PLACE, grid_join, in_blocks, place_rules, place_verdict
from fundcat.operators.evidence import publisher_identity
from fundcat.schema import AS_OF
from fundcat.tables import kept

_one = lambda: F.count(F.lit(1))


def link_register(links: DataFrame, sources: DataFrame, frontier: DataFrame, deepest: int = 3, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """``links(source_id, link, depth)`` -> the frontier after them, ``(source_id, url,
    depth)`` with the least depth of each url and at most ``most`` urls a source, those
    there before first; and the domains that nobody has approved, ``(source_id, domain,
    example)``."""
    own = sources.select(F.col("id").alias("source_id"), "domain")
    found = links.withColumn("host", X.host_of(F.col("link"))).join(own, "source_id")
    foreign = found.where("host <> domain").groupBy("source_id", F.col("host").alias("domain")).agg(F.min("link").alias("example"))
    inside = found.where((F.col("host") == F.col("domain")) & (F.col("depth") <= deepest)).groupBy("source_id", F.col("link").alias("url")).agg(F.min("depth").alias("depth"))
    both = frontier.select("source_id", "url", "depth", F.lit(0).alias("new")).unionByName(inside.select("source_id", "url", "depth", F.lit(1).alias("new")))
    each = both.groupBy("source_id", "url").agg(F.min("depth").alias("depth"), F.min("new").alias("new"))
    # Only a source with more urls than it may have ranks them, and only the new ones.
    full = each.groupBy("source_id").agg(_one().alias("n"), F.count_if(F.col("new") == 0).alias("old")).where(F.col("n") > most).select("source_id", "old")
    there = each.where("new = 0")
    roomy = each.where("new = 1").join(full, "source_id", "left_anti")
    order = Window.partitionBy("source_id").orderBy("depth", "url")
    ranked = each.where("new = 1").join(full, "source_id").withColumn("place", F.row_number().over(order)).where(F.col("place") + F.col("old") <= most)
    return reduce(DataFrame.unionByName, [df.select("source_id", "url", "depth") for df in (there, roomy, ranked)]), foreign


def publish_queue(candidates: DataFrame, results: DataFrame, parser: str, tries: int = 3) -> DataFrame:
    """Pending page candidates that have not been processed, or not by this parser, or
    are newer than their result, or have failed fewer than ``tries`` times."""
    r = results.select(F.col("candidate_id").alias("id"), "parser_version", "processed_at", "outcome", "attempts", F.lit(True).alias("done"))
    rows = candidates.where("status = 'pending' and kind <> 'domain'").join(r, "id", "left")
    due = F.col("done").isNull() | (F.col("parser_version") != parser) | (F.col("processed_at") < F.col("created_at")) | ((F.col("outcome") == "failed") & (F.col("attempts") < tries))
    return rows.where(due).select("id", "created_at", F.coalesce("attempts", F.lit(0)).alias("attempts"))


#: Pages below a program that are its application, and what rejected pages
#: are dismissed for.
APPLICATION = "/(?:apply-now|application)/?$"
DISMISSED = ("directory", "announcement", "faq", "guidelines", "application", "supporting")


def publish_decide(candidates: DataFrame, snaps: DataFrame, sources: DataFrame, opps: DataFrame, aliases: DataFrame, associations: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(id, outcome, reason, opportunity_id, dismissed)`` of each candidate: published,
    updated or skipped, by the first rule that holds; ``dismissed`` if its page is no program
    of its own. ``associations(page_id, opportunity_id, association)`` are those of
    ``related_pages``; links prove nothing here. ``evidence(opportunity_id, url)`` are pages
    that are a program's already. Candidates of one batch with the same program key are
    decided as if in the order of their ids: the first is published and the others are its
    likely duplicates."""
    newest = snaps.groupBy("url").agg(F.max_by("content_hash", F.struct("fetched_at", "id")).alias("newest_hash"))
    by_alias = aliases.groupBy("url").agg(F.min("opportunity_id").alias("by_alias"))
    live = opps.where("not is_demo")
    by_url = live.groupBy(F.col("source_url").alias("url")).agg(F.min("id").alias("by_url"))
    keyed = live.groupBy(X.program_key(F.col("name")).alias("key")).agg(_one().alias("same"), F.min("id").alias("same_id"))
    plain = lambda url: F.concat_ws("|", F.regexp_extract(url, "^https?://([^/?#]+)", 1), F.regexp_replace(X.path_of(url), "/$", ""))
    placed = live.groupBy(plain("source_url").alias("parent")).agg(_one().alias("above"), F.min("id").alias("above_id"))
    related = associations.where("association <> 'official-program-link'")
    proven = related.join(live.where("merged_into is null").select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_semi").groupBy(F.col("page_id").alias("id")).agg(F.count_distinct("opportunity_id").alias("ways"), F.min("opportunity_id").alias("by_page"))
    closed = opps.select(F.col("id").alias("grant_id"), ((F.col("publication_state") == "hidden") | (F.col("verification_status") == "archived") | F.col("merged_into").isNotNull()).alias("closed"), F.col("source_url").alias("grant_url"))
    body = snaps.select(F.col("id").alias("snapshot_id"), "body")
    c = candidates.join(body, "snapshot_id", "left").join(sources.select(F.col("id").alias("source_id"), "domain"), "source_id", "left")
    c = c.join(newest, "url", "left").join(by_alias, "url", "left").join(by_url, "url", "left").join(proven, "id", "left")
    c = c.withColumn("reason", X.once(P.classify_candidate(F.col("title"), F.col("url"), F.col("body")))).withColumn("key", X.program_key(F.col("title")))
    # The body has said what it can.
    parent = F.when(X.path_of("url").rlike(APPLICATION), F.regexp_replace(plain("url"), APPLICATION, ""))
    c = c.select("id", "url", "title", "status", "kind", "content_hash", "newest_hash", "domain", "reason", "key", parent.alias("parent"), F.col("body").isNotNull().alias("read"), F.coalesce("by_alias", "opportunity_id", "by_url", F.when(F.col("ways") == 1, F.col("by_page"))).alias("grant_id"))
    tie = related.select(F.col("page_id").alias("id"), F.col("opportunity_id").alias("grant_id"), F.lit(True).alias("tie")).distinct()
    held = evidence.select(F.col("opportunity_id").alias("grant_id"), "url", F.lit(True).alias("held")).distinct()
    c = c.join(keyed, "key", "left").join(placed, "parent", "left").join(closed, "grant_id", "left").join(tie, ["id", "grant_id"], "left").join(held, ["grant_id", "url"], "left")
    pending = (F.col("status") == "pending") & (F.col("kind") != "domain")
    approved = F.coalesce(F.col("read") & (X.host_of(F.col("url")) == F.col("domain")), F.lit(False))
    fresh = F.coalesce(F.col("newest_hash") == F.col("content_hash"), F.lit(False))
    known = F.col("closed").isNotNull()
    same_place = publisher_identity(F.col("url")) == publisher_identity(F.col("grant_url"))
    tied = F.col("tie").isNotNull() | F.col("held").isNotNull() | (same_place & F.col("reason").isNull())
    alike = F.col("same").isNotNull() | F.col("above").isNotNull()
    new = pending & approved & fresh & ~known & F.col("reason").isNull() & ~alike
    firsts = c.where(new).groupBy("key").agg(F.min("id").alias("first_id"))
    c = c.join(firsts, "key", "left")
    verdict = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    rules = (  # fixed values: what an editor reads
        F.when(~pending, verdict("skipped", "Not a pending grant candidate"))
        .when(~approved, verdict("skipped", "Source evidence or approved domain is missing"))
        .when(~fresh, verdict("skipped", "A newer source snapshot requires review"))
        .when(~known & F.col("reason").isNotNull(), verdict("skipped", F.col("reason")))
        .when(known & F.col("closed"), verdict("skipped", "Editor-hidden or merged listing stays unpublished"))
        .when(known & ~tied, verdict("skipped", "Program association unresolved; enrichment scheduled"))
        .when(known, verdict("updated", "Official evidence processed with field history and locks"))
        .when(alike | (F.col("id") != F.col("first_id")), verdict("skipped", "Likely duplicate program — merge or review the existing listing"))
        .otherwise(verdict("published", "Published unverified grant lead"))
    )
    one = F.when(F.col("above").isNull(), F.when(F.col("same") == 1, F.col("same_id"))).when(F.col("above") == 1, F.when(F.col("same").isNull() | ((F.col("same") == 1) & (F.col("same_id") == F.col("above_id"))), F.col("above_id")))
    twin = F.when(~known & F.col("reason").isNull(), one)
    answered = pending & approved & fresh
    dismissed = answered & ~known & F.coalesce(F.col("reason").isin(*[f"Non-program or unresolved page: {role}" for role in DISMISSED]), F.lit(False))
    return c.select("id", rules.alias("v"), F.when(answered, F.coalesce(F.when(known, F.col("grant_id")), twin)).alias("opportunity_id"), dismissed.alias("dismissed")).select("id", "v.outcome", "v.reason", "opportunity_id", "dismissed")


def feed_import(records: DataFrame, known: DataFrame, opps: DataFrame, aliases: DataFrame, funders: DataFrame) -> DataFrame:
    """``records(provider, external_id, url, title, funder, content)`` -> the same with
    ``hash``, ``opportunity_id`` and ``outcome``: unchanged or updated if the catalog has
    the record's program, skipped if that is hidden, archived or merged or if the same
    funder has a program of that name under another url, else published. Of records that
    share provider and number the one with the smallest content counts."""
    each = records.groupBy("provider", "external_id").agg(F.min(F.struct("content", "url", "title", "funder")).alias("r")).select("provider", "external_id", "r.*")
    each = each.withColumn("hash", F.md5(F.array_join(F.array("title", "funder", "url", "content"), "|", "")))
    by_url = aliases.select("url", "opportunity_id").union(opps.select("source_url", "id")).groupBy("url").agg(F.min("opportunity_id").alias("by_url"))
    named = opps.where("merged_into is null").join(funders.select(F.col("id").alias("funder_id"), F.lower("name").alias("l_funder")), "funder_id").select(F.lower("name").alias("l_title"), "l_funder").distinct().withColumn("taken", F.lit(True))
    prior = known.select("provider", "external_id", F.col("opportunity_id").alias("by_number"), F.col("hash").alias("prior_hash"))
    closed = opps.select(F.col("id").alias("opportunity_id"), ((F.col("publication_state") == "hidden") | (F.col("verification_status") == "archived") | F.col("merged_into").isNotNull()).alias("closed"))
    rows = each.join(prior, ["provider", "external_id"], "left").join(by_url, "url", "left").withColumn("opportunity_id", F.coalesce("by_number", "by_url"))
    rows = rows.join(closed, "opportunity_id", "left").withColumns({"l_title": F.lower("title"), "l_funder": F.lower("funder")}).join(named, ["l_title", "l_funder"], "left")
    outcome = F.when(F.col("closed"), "skipped").when(F.col("opportunity_id").isNull() & F.col("taken").isNotNull(), "skipped").when(F.col("prior_hash") == F.col("hash"), "unchanged").when(F.col("closed").isNotNull(), "updated").otherwise("published")
    return rows.select("provider", "external_id", "url", "hash", "opportunity_id", outcome.alias("outcome"))


def merge_apply(merges: DataFrame, tables: dict[str, DataFrame], uniques: dict[str, list[str]]) -> dict[str, DataFrame]:
    """``merges(id, family)`` -> the tables with every ``opportunity_id`` led to its
    family's program. Rows of a table in ``uniques`` that collide on those columns then
    leave one: the target's own row first, then the smallest."""
    out = {}
    for name, df in tables.items():
        columns = df.columns
        rows = df.join(merges.select(F.col("id").alias("opportunity_id"), "family"), "opportunity_id", "left")
        moved = rows.withColumn("moved", F.coalesce(F.col("family") != F.col("opportunity_id"), F.lit(False))).withColumn("opportunity_id", F.coalesce("family", "opportunity_id"))
        if key := uniques.get(name):
            rest = [c for c in columns if c not in key]
            moved = moved.groupBy(*key).agg(F.min(F.struct("moved", *rest)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
        out[name] = moved.select(*columns)
    return out


def save_applications(saved: DataFrame, apps: DataFrame, opps: DataFrame) -> DataFrame:
    """Applications after the saves: every saved program has one in its workspace; one that
    was known by its url alone is linked to the program, and others are new, in the stage
    ``saved``. ``(workspace_id, opportunity_id, application_id, action)``, action being
    kept, linked or added."""
    wanted = saved.select("workspace_id", "opportunity_id").distinct().join(opps.select(F.col("id").alias("opportunity_id"), F.regexp_replace("source_url", "/+$", "").alias("url")), "opportunity_id")
    earliest = F.min_by("id", F.struct("created_at", "id"))
    by_id = apps.where("opportunity_id is not null").groupBy("workspace_id", "opportunity_id").agg(earliest.alias("by_id"))
    by_url = apps.groupBy("workspace_id", F.regexp_replace("source_url", "/+$", "").alias("url")).agg(earliest.alias("by_url"))
    rows = wanted.join(by_id, ["workspace_id", "opportunity_id"], "left").join(by_url, ["workspace_id", "url"], "left")
    action = F.when(F.col("by_id").isNotNull(), "kept").when(F.col("by_url").isNotNull(), "linked").otherwise("added")
    new_id = F.concat(F.lit("s-"), "workspace_id", F.lit("-"), "opportunity_id")
    return rows.select("workspace_id", "opportunity_id", F.coalesce("by_id", "by_url", new_id).alias("application_id"), action.alias("action"))


def contribution_upsert(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(url, opportunity_id, field, user_id, proposed)`` -> one suggestion per url,
    program and field, a null program being equal to a null one, with the number of its
    submissions, one a user. A suggestion that was there keeps its id."""
    key = ["url", "opportunity_id", "field"]
    per = new.groupBy(*key).agg(F.count_distinct("user_id").alias("submissions"))
    o = old.groupBy(*key).agg(F.min("id").alias("id")).select(*[F.col(k).alias(f"o_{k}") for k in key], "id")
    same = per["url"].eqNullSafe(o["o_url"]) & per["opportunity_id"].eqNullSafe(o["o_opportunity_id"]) & per["field"].eqNullSafe(o["o_field"])
    return per.join(o, same, "left").select(*key, "submissions", "id", F.col("id").isNull().alias("is_new"))


def contribution_settle(contributions: DataFrame, opps: DataFrame, aliases: DataFrame, sources: DataFrame, fields: DataFrame) -> DataFrame:
    """``contributions(id, url, opportunity_id, field, state)`` -> ``(id, state, reason)``
    after checks: a suggested program is applied once its url is published; without an
    approved source the editors decide; a field that is found with evidence from that url
    is applied, a conflict is theirs to decide, the rest is unconfirmed."""
    shown = opps.where("publication_state = 'published' and merged_into is null")
    urls = shown.select(F.col("source_url").alias("url")).union(aliases.join(shown.select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_semi").select("url")).distinct().withColumn("listed", F.lit(True))
    approved = sources.where("enabled").select(F.col("domain").alias("host")).distinct().withColumn("approved", F.lit(True))
    facts = fields.select("opportunity_id", "field", F.col("state").alias("field_state"), F.col("evidence_url"))
    rows = contributions.where("state in ('checking', 'decision', 'unconfirmed')").withColumn("host", X.host_of(F.col("url"))).join(urls, "url", "left").join(approved, "host", "left").join(facts, ["opportunity_id", "field"], "left")
    verdict = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    program = F.col("opportunity_id").isNull()
    v = (
        F.when(program & F.col("listed"), verdict("applied", "This source is linked to a published catalog program."))
        .when(F.col("approved").isNull(), verdict("decision", "Official source approval required before checking this URL."))
        .when(~program & (F.col("field_state") == "found") & (F.col("evidence_url") == F.col("url")), verdict("applied", "Official evidence checked."))
        .when(~program & F.col("field_state").isin("conflicting", "locked_conflict"), verdict("decision", "Conflicting official evidence or a locked correction needs review."))
        .otherwise(verdict("unconfirmed", "The page did not establish the requested fact."))
    )
    return rows.select("id", v.alias("v")).select("id", "v.state", "v.reason")


def lead_upsert(reports: DataFrame, leads: DataFrame, opps: DataFrame) -> DataFrame:
    """``reports(run_id, workspace_id, url, title, warnings, seen_at)`` and the leads that are
    there, ``(workspace_id, url, title, seen_at)`` -> one lead per workspace and url, the newest
    report's, with the program that the catalog has under that url."""
    key = ["workspace_id", "url"]
    both = reports.select(*key, "title", "seen_at", F.col("run_id").alias("run")).unionByName(leads.select(*key, "title", "seen_at", F.lit(-1).cast("long").alias("run")))
    newest = both.groupBy(*key).agg(F.max(F.struct("seen_at", "run", "title")).alias("l"))
    program = opps.groupBy(F.col("source_url").alias("url")).agg(F.min("id").alias("program"))
    return newest.select(*key, "l.title", "l.run").join(program, "url", "left")


def run_status(reports: DataFrame) -> DataFrame:
    """Per research run: complete without warnings, else partial if it has leads."""
    per = reports.groupBy("run_id").agg(F.sum("warnings").alias("warnings"), F.count("url").alias("leads"))
    return per.select("run_id", "leads", F.when(F.col("warnings") == 0, "complete").when(F.col("leads") > 0, "partial").otherwise("failed").alias("status"))


def _postings(cards: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, id)``: the programs whose text holds a term. A term has no white space, so
    it lies in one word: words are looked through once each, on a term's first letters, and
    their programs are listed after that."""
    words = cards.select("id", F.explode(F.array_distinct(F.split("said", r"\s+"))).alias("word")).where("word <> ''")
    size = 3
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda i: F.substr("word", i, n))))
    vocabulary = words.select("word").distinct().select("word", F.explode(F.array_distinct(starts)).alias("start"))
    held = vocabulary.join(terms.select("term", F.substring("term", 1, size).alias("start")), "start").where(F.contains("word", "term")).select("term", "word")
    return words.join(held, "word").select("term", "id").distinct()


def search_classes(jobs: DataFrame) -> DataFrame:
    """Jobs with ``search``, one value for all that ask the same, and their terms; those
    that name no applicant or no country support nothing and are left out."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    terms = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(blank("q")), r"\s+"), lambda t: t != "")))
    rows = jobs.where((blank("applicant") != "") & (blank("country") != "")).select("job_id", terms.alias("terms"), *[F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, none)))).alias(c) for c in ("categories", "focus")], "applicant", F.coalesce("min_award", F.lit(0.0)).alias("min_award"), blank("freshness").alias("freshness"), *["country", "state", "city"])
    return rows.withColumn("search", F.xxhash64(F.to_json(F.struct(*rows.columns[1:]), {"ignoreNullFields": "false"})))


def same_searches(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the jobs that ask for the same and the same status one stands for all:
    ``(job_id, asker)`` of all jobs that can match, and the rows of the askers."""
    rows = search_classes(jobs).select("job_id", "search").join(jobs.select("job_id", F.coalesce(F.nullif("status", F.lit("")), F.lit("open")).alias("wanted")), "job_id")
    members = rows.select("job_id", F.min("job_id").over(Window.partitionBy("search", "wanted")).alias("asker"))
    return members, jobs.join(members.where("job_id = asker").select("job_id"), "job_id", "left_semi")


def target_match(jobs: DataFrame, cards: DataFrame, geos: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """``jobs(job_id, q, categories, focus, applicant, min_award, freshness, country, state,
    city)`` and ``cards`` of programs ``(id, said, status, categories, known_categories,
    applicants, maximum_award, checked, created_at, catalog_updated_at)`` that pass as
    programs -> ``(job_id, id, status, strict)``: programs that support a job's filters.
    Strict ones were checked within a day and are known to fit; the others may fit, as far
    as is known. Programs without known categories may fit any, and jobs without ask none.

    Equal searches are judged once, as are programs alike in all that decides but award and
    check. Each search is indexed by its rarest condition (one term, its categories, its
    applicant or its freshness), by which kinds of programs find it; the other conditions,
    the place among them, are checked where both meet. Jobs and programs come along in
    blocks, and rows are made of these last: no pair of them is ever shuffled or written."""
    now = X.now(as_of)
    searches = kept(search_classes(jobs), "target-searches")
    yes = lambda c: F.coalesce(c, F.lit(False))
    cards = kept(cards, "target-cards")
    said = cards.select("id", "said")
    terms = searches.select(F.explode("terms").alias("term")).distinct()
    held = _postings(said, terms).groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("held"))
    none = F.array().cast("array<string>")
    like = ["known", "own", "own_applicants", "tags", "is_new", "is_updated", "held", "rules"]
    facts = cards.select(
        "id", F.col("known_categories").alias("known"), F.col("categories").alias("own"), F.col("applicants").alias("own_applicants"), X.focus_tags(F.col("said")).alias("tags"),
        yes(F.col("created_at") >= now - X.days(7)).alias("is_new"), yes(F.col("catalog_updated_at") >= now - X.days(7)).alias("is_updated"),
        F.struct("status", yes(F.col("checked") >= now - X.days(1)).alias("recent"), F.col("maximum_award").alias("award"), "id").alias("program"),
    )
    facts = facts.join(held, "id", "left").join(place_rules(geos), "id", "left").withColumn("held", F.coalesce("held", none))
    facts = kept(facts.withColumn("kind_id", F.sha2(F.to_json(F.struct(*like)), 256)), "target-programs")

    # What a kind of programs can be found by, and how many blocks are found so.
    tag = lambda kind, c: F.concat(F.lit(kind + " "), c)
    some = lambda c, kind: F.when(F.size(c) > 0, F.transform(c, lambda v: tag(kind, v))).otherwise(F.array(F.lit(kind)))
    keys = F.concat(
        F.when(F.col("known"), some("own", "category")).otherwise(F.array(F.lit("category"))), some("own_applicants", "applicant"),
        F.array_compact(F.array(F.when(F.col("is_new"), F.lit("new")), F.when(F.col("is_updated"), F.lit("updated")))), F.transform("held", lambda t: tag("term", t)),
    )
    kinds = facts.groupBy("kind_id").agg(*[F.first(c).alias(c) for c in like])
    blocks = kept(in_blocks(facts, "kind_id", F.col("program"), 128).withColumnRenamed("rows", "programs").join(kinds, "kind_id").withColumn("keys", F.array_distinct(keys)), "target-kinds")
    sizes = blocks.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ways = F.concat(
        F.transform("terms", lambda t: F.array(tag("term", t))), F.array(F.array(F.lit("applicant"), tag("applicant", F.col("applicant")))),
        F.when(F.size("categories") > 0, F.array(F.concat(F.array(F.lit("category")), F.transform("categories", lambda c: tag("category", c))))).otherwise(F.array().cast("array<array<string>>")),
        F.when(F.col("freshness").isin("new", "updated"), F.array(F.array("freshness"))).otherwise(F.array().cast("array<array<string>>")),
    )
    asked = searches.drop("job_id").dropDuplicates(["search"])
    each = asked.select("search", F.explode(ways).alias("way")).select("search", "way", F.explode("way").alias("key")).join(sizes, "key", "left")
    costs = each.groupBy("search", "way").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    rarest = costs.groupBy("search").agg(F.min_by("way", F.struct("cost", "way")).alias("way"))
    place = F.struct(*[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in PLACE]).alias("place")
    asked = asked.select("search", "terms", "categories", "focus", "applicant", "min_award", "freshness", place).join(rarest, "search")
    left = kept(in_blocks(searches, "search", F.col("job_id"), 512).withColumnRenamed("rows", "jobs").join(asked, "search").withColumn("key", F.explode("way")), "target-asked")
    right = blocks.withColumn("key", F.explode("keys")).join(left.select("key").distinct(), "key", "left_semi")

    fits = F.array_contains("own_applicants", F.col("applicant"))
    shared = F.col("known") & F.arrays_overlap("own", "categories")
    asks_any = F.size("categories") == 0
    geo = place_verdict(F.coalesce("rules", F.array().cast(facts.schema["rules"].dataType)), F.col("place"))
    lenient = (
        (fits | (F.size("own_applicants") == 0)) & (asks_any | shared | ~F.col("known")) & ((F.size("focus") == 0) | F.arrays_overlap("focus", "tags"))
        & F.when(F.col("freshness") == "new", F.col("is_new")).when(F.col("freshness") == "updated", F.col("is_updated")).otherwise(True)
        & ((F.size("way") == 1) | (F.array_min(F.array_intersect("way", "keys")) == F.col("key"))) & (F.size(F.array_except("terms", "held")) == 0) & (geo != "excluded")
    )
    met = grid_join(left, right, "key", lenient).select("jobs", "min_award", (fits & (asks_any | shared) & (geo == "eligible")).alias("sure"), F.explode("programs").alias("p"))
    enough = yes(F.col("p.award") >= F.col("min_award"))
    met = met.where((F.col("min_award") == 0) | F.col("p.award").isNull() | enough)
    strict = F.col("sure") & ((F.col("min_award") == 0) | enough) & F.col("p.recent")
    return met.select("jobs", "p.id", "p.status", strict.alias("strict")).select(F.explode("jobs").alias("job_id"), "id", "status", "strict")


def target_cards(wide: DataFrame, origins: DataFrame, monitoring: DataFrame, snaps: DataFrame) -> DataFrame:
    """``cards`` of ``target_match`` from the wide rows, ``origins(id, publication_origin,
    category_origin, source_fetched_at, last_verified_at)``, ``monitoring`` and the newest
    snapshots: programs by their page's role or, failing that, by their name. Categories
    that a crawler took from the source are not known to be the program's."""
    bodies = snaps.select(F.col("url").alias("source_url"), "body")
    seen = monitoring.select(F.col("opportunity_id").alias("id"), "last_success_at", F.col("state").alias("monitored"))
    rows = wide.join(origins, "id", "left").join(seen, "id", "left").where("coalesce(monitored, 'active') <> 'discontinued'").join(bodies, "source_url", "left")
    body = F.coalesce("body", "summary")
    is_program = (P.page_role(F.col("name"), F.col("source_url"), body) == "program") | P.program_name(F.col("name"), F.col("source_url"), body)
    known = (F.size("categories") > 0) & ~((F.coalesce("publication_origin", F.lit("")) == "crawler") & ~F.coalesce(F.col("category_origin").isin("editor", "official"), F.lit(False)))
    said = F.lower(F.concat_ws(" ", "name", "funder", "summary", "eligibility_notes", F.array_join("categories", " ")))
    return rows.where(is_program).select("id", said.alias("said"), "status", "categories", known.alias("known_categories"), "applicants", "maximum_award", F.greatest("last_success_at", "source_fetched_at", "last_checked_at", "last_verified_at").alias("checked"), "created_at", "catalog_updated_at")


def target_counts(matches: DataFrame, wide: DataFrame, jobs: DataFrame, most: int = 10) -> DataFrame:
    """Per job: programs with another identity that match strictly and have the status that
    ``jobs(job_id, status)`` asks for, open unless said, those on the watchlist, and the
    first ``most`` to research: that may match, or match and have an unknown status."""
    named = matches.join(wide.select("id", "created_at", publisher_identity(F.col("source_url")).alias("identity")), "id")
    first = named.where("strict").groupBy("job_id", "identity").agg(F.min_by("status", F.struct("created_at", "id")).alias("status"))
    wanted = jobs.select("job_id", F.coalesce(F.nullif("status", F.lit("")), F.lit("open")).alias("wanted"))
    counts = first.join(wanted, "job_id").groupBy("job_id").agg(F.count_if(F.col("status") == F.col("wanted")).alias("matched"), F.count_if(F.col("status").isin("upcoming", "between_rounds")).alias("watchlist"))
    order = Window.partitionBy("job_id").orderBy("created_at", "id")
    todo = named.where("not strict or status = 'unknown'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    todo = todo.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("research"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("matched", "watchlist")}
    return counts.join(todo, "job_id", "full").withColumns(zero)


def ledger_admit(requests: DataFrame, month_cents: int = 1000, cents: int = 10, a_day: int = 3, days: int = 7) -> DataFrame:
    """``requests(ledger, id, topic_key, ts)`` -> ``(id, admitted)``: in order, a request
    passes if its ledger's budget of the month, number of the day and pause of the topic
    allow it. A ledger is a sequence by nature, read as a stream; ledgers go side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, month, day, spent, today = None, None, None, 0, 0
        last: dict[str, float] = {}
        for b in batches:
            out = []
            for own, i, topic, m, d, t in zip(b["ledger"], b["id"], b["topic_key"], b["month"], b["day"], b["t"], strict=True):
                if own != ledger:
                    ledger, month, day, last = own, None, None, {}
                spent, month = (spent, month) if m == month else (0, m)
                today, day = (today, day) if d == day else (0, d)
                ok = spent + cents <= month_cents and today < a_day and not (topic in last and t - last[topic] < days * 86400)
                if ok:
                    spent, today, last[topic] = spent + cents, today + 1, t
                out.append((i, ok))
            yield pd.DataFrame(out, columns=["id", "admitted"])

    rows = requests.select("ledger", "id", "topic_key", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.repartition("ledger").sortWithinPartitions("ledger", "t", "id").mapInPandas(run, "id long, admitted boolean")


def worker_throughput(samples: DataFrame, checks: DataFrame) -> DataFrame:
    """``samples(id, started, finished)``, ``checks(url, at)`` -> distinct urls checked in
    each window and checks in all. Checks are counted up to each end of a window, hour by
    hour. Of a url's checks in a window all but the first follow another one in it: distinct
    urls are the checks less the steps from one check of a url to its next that the window
    holds. Only these steps, added up by their times, meet the windows, once for all that
    have the same ends."""
    samples = samples.where("started <= finished").unionByName(samples.where("not coalesce(started <= finished, false)").withColumns({"started": F.lit(None).cast("timestamp"), "finished": F.lit(None).cast("timestamp")}))
    windows = samples.where("started is not null").select("started", "finished").distinct()
    longest = windows.agg(F.max(F.unix_micros("finished") - F.unix_micros("started")).alias("longest"))
    once = checks.where("at is not null").groupBy("at", "url").agg(_one().alias("pages"))
    hour = lambda c: F.date_trunc("hour", c)
    counted = once.groupBy("at").agg(F.sum("pages").alias("pages"), F.count("url").alias("named"))
    ends = windows.select(F.col("started").alias("at")).distinct().withColumn("side", F.lit(0)).unionByName(windows.select(F.col("finished").alias("at")).distinct().withColumn("side", F.lit(2)))
    events = counted.withColumn("side", F.lit(1)).unionByName(ends.withColumns({"pages": F.lit(0).cast("long"), "named": F.lit(0).cast("long")})).withColumn("hour", hour("at"))
    # A window's start is before the checks of its time, its end after them.
    within = Window.partitionBy("hour").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # one row an hour
    totals = counted.groupBy(hour("at").alias("hour")).agg(F.sum("pages").alias("pages"), F.sum("named").alias("named"))
    hours = totals.unionByName(ends.select(hour("at").alias("hour"), F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("named")).distinct()).groupBy("hour").agg(F.sum("pages").alias("pages"), F.sum("named").alias("named"))
    base = hours.select("hour", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("pages", "named")])
    sums = events.select("hour", "at", "side", *[F.sum(c).over(within).alias(c) for c in ("pages", "named")]).where("side <> 1").join(base, "hour")
    sums = sums.select("at", "side", (F.col("pages") + F.col("pages0")).alias("pages"), (F.col("named") + F.col("named0")).alias("named"))
    side = lambda n, at: sums.where(F.col("side") == n).select(F.col("at").alias(at), F.col("pages").alias(f"pages{n}"), F.col("named").alias(f"named{n}"))
    before = F.lag("at").over(Window.partitionBy("url").orderBy("at"))
    steps = once.where("url is not null").select(before.alias("since"), "at").where("since is not null").groupBy("since", "at").agg(_one().alias("n"))
    steps = steps.join(F.broadcast(longest), F.unix_micros("at") - F.unix_micros("since") <= F.col("longest")).select("since", F.col("at").alias("until"), "n", hour("since").alias("hour"))
    touched = windows.select("started", "finished", F.explode(F.sequence(hour("started"), hour("finished"), F.expr("interval 1 hour"))).alias("hour"))
    held = touched.join(steps, "hour").where("since >= started and until <= finished").groupBy("started", "finished").agg(F.sum("n").alias("again"))
    per = windows.join(side(0, "started"), "started").join(side(2, "finished"), "finished").join(held, ["started", "finished"], "left")
    per = per.select("started", "finished", (F.col("named2") - F.col("named0") - F.coalesce("again", F.lit(0))).alias("checked"), (F.col("pages2") - F.col("pages0")).alias("pages"))
    return samples.join(per, ["started", "finished"], "left").select("id", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("pages", F.lit(0)).alias("pages"))


def search_hits(raw: DataFrame, most: int = 30) -> DataFrame:
    """``raw(run_id, n, raw)``, JSON of search answers in order -> the first hit of each
    url of a run, at most ``most``: ``(run_id, place, url, title)``, titles without tags."""
    schema = "results array<struct<url:string,title:string,content:string>>"
    hits = raw.select("run_id", "n", F.posexplode(F.from_json("raw", schema)["results"]).alias("at", "hit")).where("at < 20")
    url = F.regexp_replace(F.regexp_replace("hit.url", "#.*$", ""), "/+$", "")
    safe = F.col("hit.url").startswith("https://")
    first = hits.where(safe).groupBy("run_id", url.alias("url")).agg(F.min(F.struct("n", "at", F.col("hit.title").alias("title"))).alias("first"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("first.n", "first.at")))
    return placed.where(F.col("place") <= most).select("run_id", "place", "url", F.trim(F.regexp_replace("first.title", "<[^>]*>", "")).alias("title"))


def cited_links(raw: DataFrame, most: int = 12) -> DataFrame:
    """``raw(id, raw)``, JSON of answers -> the first ``most`` distinct urls that their
    citations name: https, of 2000 characters at most, without secrets in the query."""
    schema = "output array<struct<type:string,content:array<struct<type:string,annotations:array<struct<type:string,url:string>>>>>>"
    messages = F.filter(F.from_json("raw", schema)["output"], lambda m: m["type"] == "message")
    notes = F.flatten(F.flatten(F.transform(messages, lambda m: F.transform(m["content"], lambda c: F.coalesce(c["annotations"], F.array().cast("array<struct<type:string,url:string>>"))))))
    good = F.filter(notes, lambda a: (a["type"] == "url_citation") & a["url"].startswith("https://") & (F.length(a["url"]) <= 2000) & ~F.regexp_extract(a["url"], r"(\?[^#]*)", 1).rlike("(?i)token|secret|password|auth|session"))
    urls = F.slice(F.array_distinct(F.transform(good, lambda a: F.regexp_replace(F.regexp_replace(a["url"], "#.*$", ""), "/+$", ""))), 1, most)
    return raw.select("id", F.posexplode(urls).alias("place", "url"))


def seed_load(seed: DataFrame, funders: DataFrame, opps: DataFrame, geos: DataFrame) -> dict[str, DataFrame]:
    """``seed(slug, name, funder, categories, places)`` -> rows to add to funders (names not
    there), programs (slugs not there), categories and places (not there, nulls alike)."""
    named = seed.select(F.col("funder").alias("name")).distinct().join(funders.select("name").distinct(), "name", "left_anti")
    programs = seed.groupBy("slug").agg(F.min(F.struct("name", "funder")).alias("s")).join(opps.select(F.col("id").alias("slug")), "slug", "left_anti").select("slug", "s.name", "s.funder")
    categories = seed.select("slug", F.explode("categories").alias("category")).distinct().join(programs.select("slug"), "slug", "left_semi")
    wanted = seed.select("slug", F.explode("places").alias("p")).select("slug", *[F.col(f"p.{c}").alias(c) for c in PLACE]).distinct()
    have = geos.select(F.col("opportunity_id").alias("h_slug"), *[F.col(c).alias(f"h_{c}") for c in PLACE])
    same = wanted["slug"] == have["h_slug"]
    for c in PLACE:
        same = same & wanted[c].eqNullSafe(have[f"h_{c}"])
    return {"funders": named, "programs": programs, "categories": categories, "places": wanted.join(have, same, "left_anti")}


#: Tables and columns that a public copy of the catalog has.
PUBLIC = {
    "opportunities": ("id", "name", "summary", "source_url", "application_status", "deadline", "opens", "rolling", "recurrence", "maximum_award", "minimum_award", "publication_state", "merged_into"),
    "opportunity_categories": ("opportunity_id", "category"),
    "opportunity_applicant_types": ("opportunity_id", "applicant_type"),
    "opportunity_geographies": ("opportunity_id", "country", "state", "city", "rule"),
    "funders": ("id", "name"),
}


def public_export(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The public columns of the public tables: no others leave, demo programs stay behind,
    and where a table names its origin that is reset."""
    out = {name: df.where("not is_demo") if "is_demo" in df.columns else df for name, df in tables.items() if name in PUBLIC}
    return {name: df.select(*[c for c in PUBLIC[name] if c in df.columns], *([F.create_map(F.lit("method"), F.lit("export")).alias("provenance")] if name == "opportunities" else [])) for name, df in out.items()}


def feed_page_checkpoint(progress: DataFrame, results: DataFrame, phases: dict[str, int]) -> DataFrame:
    """``progress(session_id, provider, phase, cursor, staged, total)`` -> where each feed
    goes on: a page that is staged is worked off first; a phase is over when nothing is
    staged and the cursor has passed its total, and the feed after its last phase, which
    ``phases`` names by provider (0 if it does not). ``results(session_id)`` are counted."""
    per = results.groupBy("session_id").agg(_one().alias("retrieved"))
    last = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in phases.items() for x in kv]), F.col("provider")), F.lit(0))
    over = (F.col("staged") == 0) & (F.col("cursor") >= F.col("total"))
    done = over & (F.col("phase") >= last)
    rows = progress.join(per, "session_id", "left")
    return rows.select(
        "session_id", "provider", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), "staged", done.alias("exhausted"), F.when(done, "received").otherwise("more").alias("status"),
        F.when(over & ~done, F.col("phase") + 1).otherwise(F.col("phase")).alias("next_phase"), F.when(over & ~done, 0).otherwise(F.col("cursor")).alias("next_cursor"),
    )


def admin_catalog(opps: DataFrame, evidence: DataFrame, fields: DataFrame, history: DataFrame, as_of: str = AS_OF, recent: int = 5) -> DataFrame:
    """Per program, for the editors: its evidence urls, the fields whose state is not
    known, all field states, its newest changes, and whether its check is overdue. Each is
    aggregated by itself before it is joined."""
    pages = evidence.groupBy(F.col("opportunity_id").alias("id")).agg(F.array_sort(F.collect_set("url")).alias("pages"))
    states = fields.groupBy(F.col("opportunity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("field", "state"))).alias("states"))
    newest = history.withColumn("place", F.row_number().over(Window.partitionBy("opportunity_id").orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("place") <= recent)
    changes = newest.groupBy(F.col("opportunity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "field", "new_value"))).alias("changes"))
    rows = opps.join(pages, "id", "left").join(states, "id", "left").join(changes, "id", "left")
    overdue = F.col("last_checked_at") < X.now(as_of) - F.make_dt_interval(hours=X.check_hours(as_of))
    return rows.select("id", "name", "publication_state", "pages", "states", F.map_from_entries(F.filter("states", lambda s: s["state"] != "known")).alias("unresolved"), "changes", overdue.alias("overdue"))


#: Words that a search term stands for, too.
RELATED_TERMS = {"music": ("performing", "artist"), "film": ("cinema", "filmmaker"), "theater": ("theatre", "performing"), "writing": ("literature", "author"), "technology": ("innovation", "research"), "nonprofit": ("community", "charity")}


def source_intent_rank(intents: DataFrame, sources: DataFrame, most: int = 8) -> DataFrame:
    """``intents(intent_id, categories, terms, country, state, city)``, ``sources(id, name,
    url, categories, scope)`` -> the best ``most`` sources of each intent by closeness and
    score, and whether none is as close as its state. They meet on a category; sources
    without any, and those for intents without any, are asked about all."""
    extra = F.create_map(*[x for k, v in RELATED_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    terms = F.array_distinct(F.concat("terms", F.flatten(F.transform("terms", lambda t: F.coalesce(F.try_element_at(extra, t), F.array().cast("array<string>"))))))
    asked = intents.withColumn("all_terms", terms)
    left = asked.select("intent_id", F.explode_outer("categories").alias("category"))
    right = sources.select("id", F.explode_outer("categories").alias("category"))
    pairs = left.join(right, "category").select("intent_id", "id").distinct()
    open_ = left.where("category is null").select("intent_id").join(right.select("id").distinct()).union(left.select("intent_id").distinct().join(right.where("category is null").select("id")))
    rows = pairs.union(open_).distinct().join(asked, "intent_id").join(sources.select("id", F.col("categories").alias("own"), "scope", F.lower(F.concat_ws(" ", "name", "url")).alias("said")), "id")
    geo = source_scope(F.col("scope"), F.col("country"), F.col("state"), F.col("city"))
    score = F.size(F.array_intersect("own", "categories")) * 10 + F.size(F.filter("all_terms", lambda t: F.contains(F.col("said"), t)))
    placed = F.coalesce("country", F.lit("")) != ""
    rows = rows.select("intent_id", "id", placed.alias("placed"), X.once(geo).alias("geo"), score.alias("score")).where(~F.col("placed") | (F.col("geo") > 0))
    order = Window.partitionBy("intent_id").orderBy(F.desc("geo"), F.desc("score"), "id")
    best = rows.withColumn("place", F.row_number().over(order))
    gap = F.col("placed") & (F.first("geo").over(order) < 3)
    return best.withColumn("gap", gap).where(F.col("place") <= most).select("intent_id", "id", "geo", "score", "place", "gap")
