"""Leads, sources, links, reviews and suggestions around the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.schema import AS_OF

#: What a lead's title, url and body must have or must not have.
TITLE_WORDS = r"\b(grants?|fellowships?|awards?|fund|funding|program)\b"
NOT_TITLES = r"(^\s*(how|what|why|where|when|who|can|does|do|is|are|should)\b|[?？]|\b(articles?|news|blogs?|tips|guides?|guidelines|faq|questions?|resources?|directories|directory|webinars?|recipients?|winners?|announces?|announced|receives?|received|awarded|stories|jobs?|careers?|performance measures|grant review|reporting|technical assistance|step-by-step)\b)"
NOT_URLS = r"^https?://[^/]+/([^?#]*/)?(articles?|news|blogs?|press|press-releases?|stories|resources|faq|jobs|careers|recipients|winners)(/|[?#]|$)"
DIRECTORY_TITLES = r"^\s*((all|current|available|our|research)\s+)?(grants?|funding|funding opportunities|fellowships?|awards?)(\s+programs?)?\s*$"
BODY_WORDS = r"\b(apply|applications?|eligib[a-z]*|proposals?|funding|supports?|provides?|awards?)\b"
SKIPPED = r"directory|supporting|non-grant|biography|No recognizable|Insufficient program"
SUPPORTING = r"apply|application|guideline|eligib|faq|deadline|\.pdf(?:$|\?)"
COMMON_NAME_WORDS = ("grant", "grants", "program", "funding", "foundation")
CONTRIBUTION_FIELDS = ("program", "status", "deadline", "minimum", "maximum", "eligibility", "applicants", "geography", "rolling")

_one = lambda: F.count(F.lit(1))


def _has(col, pattern: str) -> Column:
    return F.col(col).rlike(f"(?i){pattern}")


def lead_filter(candidates: DataFrame, snaps: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates that look like programs by title, url and body, and were not skipped
    as something else before."""
    skipped = results.where((F.col("outcome") == "skipped") & _has("reason", SKIPPED)).select(F.col("candidate_id").alias("id"))
    like = _has("title", TITLE_WORDS) & ~_has("title", NOT_TITLES) & ~_has("url", NOT_URLS) & ~_has("title", DIRECTORY_TITLES)
    bodies = snaps.where(_has("body", BODY_WORDS)).select(F.col("id").alias("snapshot_id"))
    return candidates.where(like).join(bodies, "snapshot_id", "left_semi").join(skipped, "id", "left_anti")


def unaliased_leads(candidates: DataFrame, opps: DataFrame, aliases: DataFrame, monitor: DataFrame) -> DataFrame:
    """Pending page candidates that no published program covers and no hidden, merged,
    archived or discontinued one owns."""
    gone = opps.where("publication_state = 'hidden' or verification_status = 'archived' or merged_into is not null").select("id")
    live = opps.where("publication_state = 'published' and merged_into is null")
    ended = opps.join(monitor.where("state = 'discontinued'").select(F.col("opportunity_id").alias("id")), "id", "left_semi")
    owners = gone.union(ended.select("id")).select(F.col("id").alias("opportunity_id")).distinct()
    covered = live.select(F.col("source_url").alias("url")).union(aliases.join(live.select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_semi").select("url")).union(ended.select("source_url")).distinct()
    pending = candidates.where("status = 'pending' and kind <> 'domain'")
    return pending.join(owners, "opportunity_id", "left_anti").join(covered, "url", "left_anti")


def lead_dedupe(leads: DataFrame, snaps: DataFrame) -> DataFrame:
    """One lead a url: that of the newest snapshot, then of the smallest id."""
    dated = leads.join(snaps.select(F.col("id").alias("snapshot_id"), "fetched_at"), "snapshot_id")
    return dated.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("fetched_at"), "id"))).where("place = 1").drop("place")


def candidate_supersede(candidates: DataFrame) -> DataFrame:
    """Pages with another hash than their url's newest candidate stop being pending."""
    newest = Window.partitionBy("url", F.col("kind") == "domain").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    old = (F.col("kind") != "domain") & (F.col("status") == "pending") & (F.col("content_hash") != F.first("content_hash").over(newest))
    return candidates.withColumn("status", F.when(old, "superseded").otherwise(F.col("status")))


def source_for_url(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """``url`` -> the source with that very url, else of its host; enabled first."""
    asked = urls.select("url").distinct().withColumn("domain", X.host_of(F.col("url")))
    found = asked.join(sources.select(F.col("id").alias("source_id"), F.col("url").alias("own"), "domain", "enabled"), "domain", "left")
    best = F.min(F.struct(F.col("own") != F.col("url"), ~F.col("enabled"), F.col("source_id"))).alias("best")
    return found.groupBy("url").agg(best).select("url", F.col("best.source_id").alias("source_id"))


def monitor_seed(opps: DataFrame, sources: DataFrame) -> DataFrame:
    """Hosts of visible programs: those without a source are registered, those of an
    enabled one are checked from their programs on."""
    hosts = opps.where(X.visible()).groupBy(X.host_of(F.col("source_url")).alias("domain")).agg(_one().alias("programs"), F.min("id").alias("first_id"))
    known = sources.groupBy("domain").agg(F.max("enabled").alias("enabled"))
    action = F.when(F.col("enabled").isNull(), "register").when(F.col("enabled"), "check").otherwise("none")
    return hosts.join(known, "domain", "left").withColumn("action", action).drop("enabled")


def reconcile_inventory(opps: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Visible programs and pending candidates, one row a url, programs first."""
    programs = opps.where(X.visible()).select(F.col("source_url").alias("url"), F.lit("program").alias("kind"), "id")
    pending = candidates.where("status = 'pending' and kind <> 'domain'").select("url", F.lit("candidate"), F.col("id").cast("string"))
    every = programs.union(pending).groupBy("url").agg(F.min(F.struct(F.col("kind") != "program", "id", "kind")).alias("first"))
    items = every.select("url", "first.kind", "first.id")
    return items.join(source_for_url(items, sources), "url", "left")


def external_unpublished(results: DataFrame, opps: DataFrame, aliases: DataFrame, records: DataFrame) -> DataFrame:
    """Feed results that the catalog has neither by url nor by the provider's number."""
    bare = lambda c: F.rtrim(F.col(c), F.lit("/"))
    known = opps.select(bare("source_url").alias("bare")).union(aliases.select(bare("url"))).distinct()
    return results.withColumn("bare", bare("source_url")).join(known, "bare", "left_anti").join(records, ["provider", "external_id"], "left_anti").drop("bare")


def linked_page_join(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """``links(url, link)``, ``evidence(opportunity_id, url)`` -> linked pages that one
    program alone links to."""
    both = links.select("url", "link").distinct().join(evidence, "url").groupBy("link")
    return both.agg(F.min("opportunity_id").alias("opportunity_id"), F.max("opportunity_id").alias("last")).where("opportunity_id = last").drop("last")


def supporting_links(links: DataFrame, most: int = 30) -> DataFrame:
    """Per page, its distinct links to applications, guidelines, questions and dates;
    documents after pages, in the page's order."""
    found = links.where((F.col("link") != F.col("url")) & _has("link", SUPPORTING)).groupBy("url", "link").agg(F.min(F.struct("id", "n")).alias("at"))
    order = Window.partitionBy("url").orderBy(_has("link", r"\.pdf"), "at")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("url", "link", "place")


def page_priority(urls: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """How likely a url leads to a program, by its path."""
    path = F.lower(X.path_of(F.col("url")))
    hits = sum((F.when(F.contains(path, F.lit(t)), 10).otherwise(0) for t in terms), F.lit(0))
    flag = lambda p, n: F.when(path.rlike(p), n).otherwise(0)
    score = hits + flag("grant|fellowship|fund|award", 4) + flag(r"apply|application|guideline|eligib|deadline|\.pdf$", 3) - flag("news|blog|recipient|winner", 8)
    return urls.withColumn("score", score)


def research_link_rank(programs: DataFrame, links: DataFrame) -> DataFrame:
    """``programs(id, name, missing)``, ``links(id, link)`` -> links worth reading for
    the missing fields, best first."""
    lacks = lambda *f: F.arrays_overlap("missing", F.array(*map(F.lit, f)))
    some = lambda cond, *t: F.when(cond, F.array(*map(F.lit, t))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower("name"), r"\W+"), lambda w: (F.length(w) > 3) & ~w.isin(*COMMON_NAME_WORDS))
    terms = F.concat(
        some(lacks("status", "deadline", "opens", "recurrence"), "application", "apply", "deadline", "dates"),
        some(lacks("eligibility", "applicants", "geography"), "eligibility", "guidelines", "faq", "requirements"),
        some(lacks("maximum"), "amount", "guidelines", "funding"),
        F.array(F.lit("pdf")),
    )
    asked = programs.select("id", words.alias("words"), terms.alias("terms"))
    rows = links.select("id", "link").distinct().join(asked, "id")
    hits = lambda c: F.size(F.filter(c, lambda w: F.contains(F.lower("link"), w)))
    scored = rows.select("id", "link", (hits("words") * 4 + hits("terms") * 2).alias("score")).where("score > 0")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "link")))


def robots_filter(urls: DataFrame, rules: DataFrame, bot: str = "fundbot") -> DataFrame:
    """``urls(url)`` with ``allowed``. Rules that name the bot go before those for all;
    the longest pattern without its stars decides, allow before disallow."""
    named = (F.col("agent") != "*") & F.contains(F.lit(bot.lower()), F.lower("agent"))
    own = rules.where(named | (F.col("agent") == "*")).withColumn("named", named)
    own = own.withColumn("any", F.max("named").over(Window.partitionBy("host"))).where("named = any")
    end = F.col("pattern").endswith("$")
    text = F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"[.+?^${}()|\[\]\\]", r"\\$0")
    own = own.select("host", "allow", F.length(F.replace("pattern", F.lit("*"))).alias("size"), F.concat(F.lit("^"), F.replace(text, F.lit("*"), F.lit(".*")), F.when(end, "$").otherwise("")).alias("re"))
    # Rules of a host are few: one row a host, and every url meets it once.
    each = own.groupBy("host").agg(F.sort_array(F.collect_set(F.struct((-F.col("size")).alias("rank"), (~F.col("allow")).alias("deny"), "re"))).alias("rules"))
    asked = urls.select("url").distinct().withColumn("host", X.host_of(F.col("url"))).withColumn("path", F.regexp_extract("url", r"^https?://[^/]+(/[^#]*)", 1))
    first = F.get(F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["re"])), F.lit(0))
    return asked.join(each, "host", "left").select("url", F.coalesce(~first["deny"], F.lit(True)).alias("allowed"))


def normalize_location(df: DataFrame) -> DataFrame:
    """Country, state, city and postal code in one spelling."""
    clean = lambda c: F.substring(F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "), 1, 100)
    raw = clean("country")
    country = F.when(raw.rlike(r"(?i)^(us|usa|u\.s\.|united states( of america)?)$"), "United States").when(raw.rlike("(?i)^(uk|gb|great britain|united kingdom)$"), "United Kingdom").when(raw.rlike("(?i)^(worldwide|global|international)$"), "Worldwide").otherwise(raw)
    us = country.isin("", "United States")
    states = {"NY": "New York", "CA": "California", "TX": "Texas", "NEW YORK": "New York", "CALIFORNIA": "California", "TEXAS": "Texas"}
    state = F.coalesce(F.when(us, F.try_element_at(F.create_map(*[F.lit(x) for p in states.items() for x in p]), F.upper(clean("state")))), clean("state"))
    city = F.when(us & clean("city").rlike("(?i)^(nyc|new york|new york city)$"), "New York City").otherwise(clean("city"))
    post = clean("postal_code")
    postal = F.when(us, F.when(post.rlike(r"^\d{5}(-\d{4})?$"), F.substring(post, 1, 5)).otherwise("")).when(post.rlike(r"^[\p{L}\d][\p{L}\d -]{0,19}$"), F.replace(F.upper(post), F.lit(" "))).otherwise("")
    return df.withColumns({"country": country, "state": state, "city": city, "postal_code": postal})


def review_validate(reviews: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """``violations``: what keeps a review from being saved, in the rules' order."""
    c, today = F.col, F.to_date(X.now(as_of))
    rules = (
        ("name", ~F.length(F.trim("name")).between(3, 250)),
        ("summary", ~F.length(F.trim("summary")).between(20, 3000)),
        ("currency", ~c("currency").rlike("^[A-Z]{3}$")),
        ("amount", ~c("minimum").between(0, 100_000_000) | ~c("maximum").between(0, 100_000_000)),
        ("minimum exceeds maximum", c("minimum") > c("maximum")),
        ("upcoming needs opening", (c("status") == "upcoming") & c("opens").isNull()),
        ("deadline before opening", c("deadline") <= c("opens")),
        ("passed deadline", (c("status") == "open") & (c("deadline") < today)),
        ("future opening", (c("status") == "open") & (c("opens") > today)),
    )
    return reviews.withColumn("violations", F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules])))


def review_duplicates(reviews: DataFrame, opps: DataFrame) -> DataFrame:
    """Reviews whose letters of the name, or whose url, another program has."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = opps.groupBy(bare("name").alias("key")).agg(F.min("id").alias("program"))
    urls = opps.groupBy(F.col("source_url").alias("key")).agg(F.min("id").alias("program"))
    by_name = reviews.select("id", bare("name").alias("key"), F.lit("name").alias("by")).join(names, "key")
    by_url = reviews.select("id", F.col("url").alias("key"), F.lit("url").alias("by")).join(urls, "key")
    return by_name.union(by_url).select("id", "by", "program")


def contribution_validate(df: DataFrame) -> DataFrame:
    """``violation``: the first rule that a suggestion breaks, or null."""
    c = F.col
    broken = (
        F.when(~c("field").isin(*CONTRIBUTION_FIELDS), "field")
        .when(F.length(F.trim("proposed")) > 2000, "length")
        .when((c("field") == "program") != (c("opportunity_id") == ""), "program")
        .when((c("field") != "program") & (F.trim("proposed") == ""), "proposal")
    )
    return df.withColumn("violation", broken)


def contribution_rollup(contributions: DataFrame, submissions: DataFrame) -> DataFrame:
    """Suggestions with their submissions, those to decide first, newest first."""
    each = submissions.groupBy(F.col("contribution_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n", "proposed", "note"))).alias("submissions"))
    return contributions.join(each, "id", "left").withColumn("decide", F.col("state") == "decision")


def queue_stats(jobs: DataFrame, as_of: str = AS_OF) -> DataFrame:
    day = X.now(as_of) - F.expr("interval 24 hours")
    waiting = F.col("status").isin("queued", "running")
    done = F.col("status").isin("complete", "partial") & (F.col("finished_at") > day)
    return jobs.agg(F.count_if(waiting).alias("waiting"), F.count_if(waiting & (F.col("created_at") < day)).alias("overdue"), F.count_if(done).alias("finished"), F.max("last_served_at").alias("last_served_at"))


def ledger_stats(ledger: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The month's spending up to now, one row."""
    month = ledger.where((F.col("created_at") >= F.date_trunc("month", X.now(as_of))) & (F.col("created_at") <= X.now(as_of)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return month.agg(_one().alias("attempts"), total("reserved_cents").alias("reserved_cents"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("created_at").alias("last_attempt"), total("queued_count").alias("queued_links"), total("domain_count").alias("suggested_domains"))


def reconcile_summary(items: DataFrame, events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Per run: outcomes of its inventory and of its events; partial while unchecked."""
    status, elsewhere = F.col("status"), F.col("reason") == "Continued in newer inventory"
    per = items.groupBy("run_id").agg(
        _one().alias("inventory"),
        F.count_if((status == "complete") & ~elsewhere).alias("checked"),
        F.count_if(elsewhere).alias("continued_elsewhere"),
        F.count_if(status.isin("queued", "running")).alias("unchecked"),
        F.count_if(status == "blocked").alias("retry_scheduled"),
        F.count_if(status == "ambiguous").alias("research_needed"),
        F.count_if((status == "blocked") & (F.col("next_attempt_at") <= X.now(as_of))).alias("overdue_retries"),
    )
    facts = F.when((F.col("action") == "facts-resolved") & F.col("detail").rlike("^[0-9]+$"), F.col("detail").try_cast("long"))
    out = events.groupBy("run_id").agg(F.count_if(F.col("action") == "merged").alias("merged"), F.count_if(F.col("action") == "hidden").alias("hidden"), F.coalesce(F.sum(facts), F.lit(0)).alias("facts_resolved"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("merged", "hidden", "facts_resolved")}
    return per.join(out, "run_id", "left").withColumns(zero).withColumn("status", F.when(F.col("unchecked") > 0, "partial").otherwise("complete"))


def field_history_recent(history: DataFrame, most: int = 20) -> DataFrame:
    """A program's last changes; ``latest`` marks the last one of its field."""
    newest = (F.desc("created_at"), F.desc("id"))
    place = F.row_number().over(Window.partitionBy("opportunity_id").orderBy(*newest))
    latest = F.row_number().over(Window.partitionBy("opportunity_id", "field").orderBy(*newest)) == 1
    return history.withColumns({"place": place, "latest": latest}).where(F.col("place") <= most)


def field_rollback(requests: DataFrame, history: DataFrame, fields: DataFrame) -> DataFrame:
    """``(opportunity_id, field)`` asked to go back: the value before the last change,
    if the field still has that change's value. The field is locked then."""
    key = ["opportunity_id", "field"]
    last = history.join(requests.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.max_by(F.struct("old_value", "new_value"), F.struct("created_at", "id")).alias("last"))
    same = F.col("value").eqNullSafe(F.col("last.new_value"))
    both = requests.select(*key).join(last, key, "left").join(fields.select(*key, "value", "locked"), key, "left")
    outcome = F.when(F.col("last").isNull(), "no history").when(~same, "changed since").otherwise("rolled back")
    back = F.col("outcome") == "rolled back"
    return both.withColumn("outcome", outcome).select(*key, "outcome", F.when(back, F.col("last.old_value")).otherwise(F.col("value")).alias("value"), (back | F.col("locked")).alias("locked"))


def admin_stats(opps: DataFrame, candidates: DataFrame, fields: DataFrame, history: DataFrame, results: DataFrame) -> DataFrame:
    """Counts for the editors, as one row of one-row aggregates."""
    published = opps.where(~F.col("is_demo") & (F.col("publication_state") == "published") & F.col("merged_into").isNull()).agg(_one().alias("published"))
    domains = candidates.where("status = 'pending' and kind = 'domain'").agg(F.count_distinct("url").alias("domains"))
    locked = fields.where("state = 'locked_conflict'").agg(_one().alias("locked"))
    facts = history.where("action = 'automatic' and old_value is null").agg(_one().alias("facts_resolved"))
    done = results.agg(*[F.count_if(F.col("outcome") == o).alias(o + "_pages") for o in ("published", "updated", "skipped")])
    # Each side is the one row of a global aggregate.
    return published.join(F.broadcast(domains)).join(F.broadcast(locked)).join(F.broadcast(facts)).join(F.broadcast(done))
