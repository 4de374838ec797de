"""Counts, totals and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.schema import AS_OF

n_if = lambda c: F.count(F.when(c, 1))


def category_coverage(opps: DataFrame, monitor: DataFrame, categories: DataFrame) -> DataFrame:
    gone = monitor.where("state = 'discontinued'").select(F.col("opportunity_id").alias("id"))
    shown = opps.where(~F.col("is_demo") & (F.col("publication_state") == "published") & (F.col("verification_status") != "archived")).join(gone, "id", "left_anti")
    return categories.join(shown.select(F.col("id").alias("opportunity_id")), "opportunity_id").groupBy("category").agg(F.count_distinct("opportunity_id").alias("total"))


def discovery_counts(wide: DataFrame, saved: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Per workspace: catalog size, saved programs and saved ones due in 30 days."""
    today = F.to_date(X.now(as_of))
    due = F.col("deadline").between(today, F.date_add(today, 30)) & ~F.col("status").isin("closed", "discontinued", "between_rounds", "round_ended")
    mine = saved.select("workspace_id", F.col("opportunity_id").alias("id")).join(wide.select("id", "deadline", "status"), "id")
    per = mine.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("saved"), n_if(due).alias("deadlines"))
    return per.join(F.broadcast(wide.agg(F.count(F.lit(1)).alias("catalog"))))


def completeness(wide: DataFrame) -> DataFrame:
    """Programs with a known value, per field, one row."""
    known = {"deadline": F.col("deadline").isNotNull() | F.col("rolling"), "maximum": F.col("maximum_award").isNotNull(), "minimum": F.col("minimum_award").isNotNull(), "status": F.col("application_status") != "unknown", "eligibility": ~F.col("eligibility_notes").isin("", "Unknown"), "recurrence": F.col("recurrence").isNotNull(), "opens": F.col("opens").isNotNull(), "applicants": F.size("applicants") > 0, "categories": F.size("categories") > 0}
    return wide.agg(F.count(F.lit(1)).alias("programs"), *[n_if(c).alias(k) for k, c in known.items()])


def monitor_stats(opps: DataFrame, monitor: DataFrame) -> DataFrame:
    rows = visible_programs(opps).select("id").join(monitor.withColumnRenamed("opportunity_id", "id"), "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("programs"), n_if(F.col("state") == "discontinued").alias("archived"), n_if(F.col("consecutive_failures") >= 3).alias("failing"), n_if(F.col("last_success_at").isNull()).alias("never_checked"))


def visible_programs(opps: DataFrame) -> DataFrame:
    return opps.where(X.visible())


def stage_counts(apps: DataFrame) -> DataFrame:
    """Applications per workspace and stage, and all stages together."""
    return apps.where("not archived").rollup("workspace_id", "stage").agg(F.count(F.lit(1)).alias("n")).where("workspace_id is not null").select("workspace_id", F.coalesce("stage", F.lit("all")).alias("stage"), "n")


def application_list(apps: DataFrame, tasks: DataFrame, opps: DataFrame) -> DataFrame:
    """Applications with task counts and the date they go by."""
    per = tasks.where("not deleted").groupBy(F.col("application_id").alias("id")).agg(F.count(F.lit(1)).alias("tasks"), n_if(F.col("completed")).alias("done"))
    dates = opps.select(F.col("id").alias("opportunity_id"), "deadline")
    rows = apps.where("not archived").join(per, "id", "left").join(dates, "opportunity_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", "workspace_id", "stage", zero("tasks"), zero("done"), F.coalesce("deadline", "target_date").alias("due"))


def budget_totals(prep: DataFrame) -> DataFrame:
    """Cents per application: each item is rounded to cents before it is summed."""
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    rows = prep.where("not archived and kind = 'budget'").select("application_id", cents("cost").alias("cost"), cents("requested").alias("requested"))
    return rows.groupBy("application_id").agg(F.sum("cost").alias("cost_cents"), F.sum("requested").alias("requested_cents"), F.sum(F.col("cost") - F.col("requested")).alias("other_cents"))


def open_tasks(tasks: DataFrame, apps: DataFrame, saved: DataFrame) -> DataFrame:
    """Open tasks of active applications, and of saved programs in the workspace that
    saved them, with their place in the workspace's list."""
    active = apps.where("not archived and stage not in ('awarded', 'declined', 'withdrawn')").select(F.col("id").alias("application_id"), "workspace_id")
    of_apps = tasks.where("not completed and not deleted").join(active, "application_id").select("id", "workspace_id", "due")
    mine = apps.select(F.col("id").alias("application_id"), "workspace_id", "opportunity_id").join(active.select("application_id"), "application_id", "left_anti")
    of_saved = tasks.where("not completed and not deleted").join(mine, "application_id").join(saved.select("workspace_id", "opportunity_id").distinct(), ["workspace_id", "opportunity_id"], "left_semi").select("id", "workspace_id", "due")
    order = Window.partitionBy("workspace_id").orderBy(F.asc_nulls_last("due"), "id")
    return of_apps.union(of_saved).withColumn("place", F.row_number().over(order))


def source_coverage(sources: DataFrame, snaps: DataFrame) -> DataFrame:
    """Per source: whether it is enabled, its urls and its snapshots."""
    per = snaps.groupBy(X.host_of(F.col("url")).alias("domain")).agg(F.count_distinct("url").alias("urls"), F.count(F.lit(1)).alias("snapshots"))
    return sources.join(per, "domain", "left").select("id", "enabled", F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


def crawl_summary(visits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per run: visits, failures, and sources seen; and the backlog of pending page
    candidates, which is the same for all."""
    per = visits.groupBy("run").agg(F.count(F.lit(1)).alias("pages"), n_if(F.col("outcome") == "failed").alias("failed"), F.count_distinct("source_id").alias("sources"))
    backlog = candidates.where("status = 'pending' and kind <> 'domain'").agg(F.count(F.lit(1)).alias("backlog"))
    return per.join(F.broadcast(backlog))  # one row


def source_health(sources: DataFrame, visits: DataFrame) -> DataFrame:
    per = visits.groupBy(F.col("source_id").alias("id")).agg(F.max(F.when(F.col("outcome") != "failed", F.col("ts"))).alias("last_success"), n_if(F.col("outcome") == "failed").alias("failures"), F.count(F.lit(1)).alias("visits"))
    return sources.select("id", "enabled").join(per, "id", "left")


def evidence_fingerprint(snaps: DataFrame) -> DataFrame:
    """Per url: its versions' hashes in order, as one text."""
    pairs = F.array_sort(F.collect_list(F.struct("fetched_at", "id", "content_hash")))
    return snaps.groupBy("url").agg(F.array_join(F.transform(pairs, lambda p: p["content_hash"]), "|").alias("fingerprint"))


def snapshot_changes(snaps: DataFrame) -> DataFrame:
    """Snapshots whose hash or extractor is not that of the one before, with the id of
    that one. Bodies stay out of the window and are fetched by id."""
    w = Window.partitionBy("url").orderBy("fetched_at", "id")
    rows = snaps.select("id", "url", "content_hash", "extractor", F.lag("content_hash").over(w).alias("old_hash"), F.lag("extractor").over(w).alias("old_extractor"), F.lag("id").over(w).alias("before"), F.row_number().over(w).alias("n"))
    changed = (F.col("n") == 1) | (F.col("content_hash") != F.col("old_hash")) | (F.col("extractor") != F.col("old_extractor"))
    excerpts = snaps.select(F.col("id").alias("before"), F.substring("body", 1, 12000).alias("previous_excerpt"))
    return rows.where(changed).join(excerpts, "before", "left").select("id", "url", F.when(F.col("n") == 1, "new").otherwise("changed").alias("kind"), "before", "previous_excerpt")


def enrichment_order(opps: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """A fair order over sources: rank within the source by what is missing."""
    today = F.to_date(X.now(as_of))
    score = lambda c, n: F.when(c, n).otherwise(0)
    total = score(F.col("deadline").between(today, F.date_add(today, 30)), 8) + score(F.col("application_status") == "unknown", 4) + score(F.col("deadline").isNull() & ~F.col("rolling"), 2) + score(F.col("maximum_award").isNull(), 1) + score(F.col("eligibility_notes").isin("", "Unknown"), 1)
    rows = visible_programs(opps).select("id", X.host_of(F.col("source_url")).alias("source"), total.alias("score"), "last_checked_at")
    turn = Window.partitionBy("source").orderBy(F.desc("score"), F.asc_nulls_first("last_checked_at"), "id")
    return rows.select("id", "source", "score", F.row_number().over(turn).alias("turn"))


def frontier_select(opps: DataFrame, monitor: DataFrame, per_source: int = 50, limit: int = 200, as_of: str = AS_OF) -> DataFrame:
    """Urls to fetch in a run: due ones, a bounded number a source, turn by turn."""
    due = X.now(as_of) - F.make_dt_interval(hours=X.check_hours(as_of)) >= F.col("last_checked_at")
    rows = visible_programs(opps).where(due).select("id", X.host_of(F.col("source_url")).alias("source"), "last_checked_at")
    turn = Window.partitionBy("source").orderBy("last_checked_at", "id")
    few = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_source)
    return few.orderBy("turn", "last_checked_at", "id").limit(limit).select("id", "source", "turn")


def prune_snapshots(snaps: DataFrame, opps: DataFrame, referrers: DataFrame, keep_days: int = 90, most: int = 500, as_of: str = AS_OF) -> DataFrame:
    """The oldest snapshots that nothing refers to: no row of ``referrers(snapshot_id)``,
    the union of the tables that hold snapshots, and no program by its url."""
    used = referrers.select(F.col("snapshot_id").alias("id")).distinct()
    urls = opps.select(F.col("source_url").alias("url")).distinct()
    old = snaps.where(F.col("fetched_at") < X.now(as_of) - X.days(keep_days)).select("id", "url", "fetched_at")
    return old.join(used, "id", "left_anti").join(urls, "url", "left_anti").orderBy("fetched_at", "id").limit(most).select("id", "url", "fetched_at")


def activity_feed(logs: dict[str, tuple[DataFrame, str, str]], most: int = 200) -> DataFrame:
    """Event logs as one feed, newest first: ``(ts, kind, ref)``. ``logs`` names for each
    log its rows, the time column and the column that says what happened; a log gives its
    ``most`` newest rows to the union, so the feed is never sorted whole."""
    parts = []
    for name, (rows, ts, what) in logs.items():
        part = rows.select(F.col(ts).alias("ts"), F.concat_ws(":", F.lit(name), F.col(what).cast("string")).alias("kind"), F.col("ref").cast("string").alias("ref"))
        parts.append(part.orderBy(F.desc("ts"), "kind", "ref").limit(most))
    feed = parts[0]
    for part in parts[1:]:
        feed = feed.unionByName(part)
    return feed.orderBy(F.desc("ts"), "kind", "ref").limit(most)


def attention_queue(opps: DataFrame, monitor: DataFrame, fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items that need a decision: likely duplicates, locked fields that differ from the
    evidence, programs whose checks fail, and domains that nobody has approved."""
    from fundcat.operators.catalog import duplicate_programs

    text = lambda c: F.col(c).cast("string")
    twins = duplicate_programs(visible_programs(opps)).select("id", F.lit("duplicate").alias("kind"), F.col("first_id").alias("detail"))
    failing = monitor.where("consecutive_failures >= 3").select(F.col("opportunity_id").alias("id"), F.lit("unavailable").alias("kind"), text("consecutive_failures").alias("detail"))
    locked = fields.where("state = 'locked_conflict'").select(F.col("opportunity_id").alias("id"), F.lit("locked").alias("kind"), F.col("field").alias("detail"))
    domains = candidates.where("status = 'pending' and kind = 'domain'").groupBy(X.host_of(F.col("url")).alias("detail")).agg(F.min("id").cast("string").alias("id")).select("id", F.lit("domain").alias("kind"), "detail")
    return twins.unionByName(failing).unionByName(locked).unionByName(domains)


#: Words that a search does without.
STOP_WORDS = ("and", "for", "the", "with")


def search_intent(requests: DataFrame) -> DataFrame:
    """``requests(conv_id, turn, q, categories, country, state, city, applicant, status,
    min_award)`` -> the key that equal searches share: the first twelve distinct tokens of
    3 to 30 letters without stop words, sorted categories, the place in lower case, and
    the constraints."""
    said = F.lower(F.concat_ws(" ", "q", F.array_join("categories", " ")))
    tokens = F.array_distinct(F.regexp_extract_all(said, F.lit("[a-z0-9]{3,30}"), F.lit(0)))
    terms = F.array_sort(F.slice(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)), 1, 12))
    asked = F.array_sort(F.filter(F.split(F.lower("q"), r"\s+"), lambda t: t != ""))
    place = F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("country", "state", "city")]))
    key = F.concat_ws("\n", F.array_join(terms, " "), F.array_join(F.array_sort("categories"), "|"), place, F.array_join(asked, " "), "applicant", "status", F.col("min_award").cast("long").cast("string"))
    return requests.select("conv_id", "turn", F.array_join(terms, " ").alias("tokens"), F.sha2(key, 256).alias("intent"))


def resolve_facts(facts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Per program and field, the value that the newest usable cycle agrees on, or why
    there is none. Counting distinct values is enough; excerpts never meet."""
    year = F.when(F.col("cycle").rlike("^[0-9]{4}"), F.substring("cycle", 1, 4).cast("int"))
    this_year = F.year(X.now(as_of))
    rows = facts.select("opportunity_id", "field", "value", "conflict", year.alias("year"), (F.col("cycle").isNull() | (year >= this_year)).alias("viable"))
    newest = F.max(F.when(F.col("viable"), F.col("year"))).over(Window.partitionBy("opportunity_id", "field"))
    rows = rows.withColumn("newest", newest).withColumn("usable", F.col("viable") & (F.col("newest").isNull() | F.col("year").eqNullSafe(F.col("newest"))))
    one = F.when(F.col("usable"), F.col("value"))
    sums = rows.groupBy("opportunity_id", "field").agg(F.coalesce(F.max(F.col("usable") & F.col("conflict")), F.lit(False)).alias("clash"), F.min(one).alias("low"), F.max(one).alias("high"))
    value = F.when(~F.col("clash") & (F.col("low") == F.col("high")), F.col("low"))
    reason = F.when(F.col("clash"), "conflicting timeline").when(F.col("low").isNull(), "only historical evidence").when(F.col("low") != F.col("high"), "conflicting evidence")
    per = sums.select("opportunity_id", "field", value.alias("value"), reason.alias("reason"))
    whole = Window.partitionBy("opportunity_id")
    has = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).over(whole)
    per = per.select("*", has("rolling").alias("rolling"), has("deadline").alias("due"))
    both = F.coalesce((F.col("rolling") == "true") & F.col("due").isNotNull(), F.lit(False))
    cancelled = F.coalesce(both & F.col("field").isin("rolling", "deadline"), F.lit(False))
    elapsed = F.coalesce(~both & (F.col("field") == "status") & (F.col("value") == "open") & (F.col("due") < F.date_format(X.now(as_of), "yyyy-MM-dd")), F.lit(False))
    return per.select("opportunity_id", "field", F.when(~cancelled & ~elapsed, F.col("value")).alias("value"), F.when(cancelled, "rolling and fixed deadline").when(elapsed, "open but elapsed").otherwise(F.col("reason")).alias("reason"))


def apply_facts(resolved: DataFrame, opps: DataFrame) -> DataFrame:
    """What each resolved fact does to the program: found, unchanged or conflicting."""
    now_ = opps.select(F.col("id").alias("opportunity_id"), F.col("application_status").alias("status"), F.col("recurrence"), F.col("deadline").cast("string").alias("deadline"), F.col("rolling").cast("string").alias("rolling"), F.floor("maximum_award").cast("string").alias("maximum"))
    current = now_.unpivot("opportunity_id", ["status", "recurrence", "deadline", "rolling", "maximum"], "field", "current")
    rows = resolved.join(current, ["opportunity_id", "field"])
    state = F.when(F.col("value").isNull() & F.col("reason").contains("only historical"), "not_checked").when(F.col("value").isNull(), "conflicting").when(F.col("value").eqNullSafe(F.col("current")), "unchanged").otherwise("found")
    return rows.select("opportunity_id", "field", "current", "value", state.alias("state"))


def missing_fields(opps: DataFrame) -> DataFrame:
    """``(id, field)`` still empty; rolling programs need no dates."""
    lacks = {"deadline": F.col("deadline").isNull() & ~F.col("rolling"), "maximum": F.col("maximum_award").isNull(), "status": F.col("application_status") == "unknown", "eligibility": F.col("eligibility_notes").isin("", "Unknown")}
    fields = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in lacks.items()]))
    return visible_programs(opps).select("id", F.explode(fields).alias("field"))


def scalars(opps: DataFrame, snaps: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Per program: its key, hours to the next check, host and path."""
    return opps.select("id", X.program_key(F.col("name")).alias("key"), X.check_hours(as_of).alias("hours"), X.host_of(F.col("source_url")).alias("host"), X.path_of(F.col("source_url")).alias("path"))


def page_scalars(snaps: DataFrame) -> DataFrame:
    """Per snapshot: the page's amount, words and crawl day."""
    body = F.col("body")
    return snaps.select("id", X.parse_amount(body).alias("amount"), X.words_in(body).alias("words"), X.schedule_day(F.col("fetched_at")).alias("day"))


def keyword_scrub(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.scrub(F.col("text")).alias("text"))
