"""Drafted checklists that their sources support, and editors' reviews of programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.functions.places import location_lines
from fundcat.operators.page_facts import MONTHS, folded
from fundcat.schema import APPLICANT_TYPES, AS_OF, CATEGORIES
from fundcat.tables import kept

# ---- drafts ------------------------------------------------------------------

#: Lengths of a drafted task's texts, tasks of a draft, and what is noted
#: where a date is not supported.
TASK_LENGTHS = {"title": (1, 200), "notes": (0, 2000), "source_excerpt": (10, 1000), "uncertainty": (0, 1000), "date_excerpt": (0, 1000)}
MOST_TASKS = 40
NO_DATE = "No supported due date was found; choose a date if needed."


def supports_date(day, excerpt) -> Column:
    """Whether an excerpt names a date: as ISO, by month name or its three letters, before
    or after the day, or in the US order of numbers."""
    parts = F.split(F.coalesce(day, F.lit("")), "-")
    text, year = F.lower(F.coalesce(excerpt, F.lit(""))), F.get(parts, F.lit(0))
    month, d = (F.get(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    name = F.lower(F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1))
    named = F.concat(F.lit("(?:"), name, F.lit("|"), F.substring(name, 1, 3), F.lit(r"\.?)"))
    edge, end = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"
    n = d.cast("string")
    ways = [
        F.concat(F.lit(edge), named, F.lit(r"\s+0?"), n, F.lit(r"(?:st|nd|rd|th)?[,]?\s+"), year, F.lit(end)),
        F.concat(F.lit(edge + "0?"), n, F.lit(r"\s+"), named, F.lit(r"[,]?\s+"), year, F.lit(end)),
        F.concat(F.lit(edge + "0?"), month.cast("string"), F.lit("/0?"), n, F.lit("/"), year, F.lit(end)),
    ]
    said = F.contains(text, day)
    for way in ways:
        said = said | F.regexp_like(text, way)
    return F.coalesce(name.isNotNull() & said, F.lit(False))


def draft_validate(tasks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tasks(draft_id, n, title, notes, due_date, source_url, source_excerpt,
    uncertainty, date_excerpt)``, ``sources(url, text)``, one text a url -> what became of
    each draft, ``(draft_id, outcome, reason)``, and the tasks of those kept. One task that
    breaks a length or whose excerpt its source does not hold rejects its draft; a date that
    the source does not support is taken out with a note. White space is folded on both
    sides; nulls count as empty, and a task without a known source is not grounded."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = tasks.join(sources.select(F.col("url").alias("source_url"), folded(F.col("text")).alias("_source")), "source_url", "left")
    fits = F.lit(True)
    for name, (least, most) in TASK_LENGTHS.items():
        fits = fits & F.length(text(F.col(name))).between(least, most)
    held = lambda c: F.coalesce(F.contains("_source", folded(F.col(c))), F.lit(False))
    dated = (text(F.col("date_excerpt")) != "") & held("date_excerpt") & supports_date(F.col("due_date"), F.col("date_excerpt"))
    rows = rows.select(*tasks.columns, fits.alias("_fits"), held("source_excerpt").alias("_grounded"), (F.col("due_date").isNotNull() & ~dated).alias("_undated"))
    per = rows.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("_fits").alias("fits"), F.bool_and("_grounded").alias("grounded"))
    reason = F.when(~F.col("fits") | (F.col("n") > MOST_TASKS), "malformed").when(~F.col("grounded"), "unsupported task")
    drafts = per.select("draft_id", F.when(reason.isNull(), "kept").otherwise("rejected").alias("outcome"), reason.alias("reason"))
    noted = F.when(F.col("_undated"), F.concat_ws(" ", F.nullif("uncertainty", F.lit("")), F.lit(NO_DATE))).otherwise(F.col("uncertainty"))
    good = rows.join(drafts.where("outcome = 'kept'").select("draft_id"), "draft_id", "left_semi")
    same = {"due_date": F.when(~F.col("_undated"), F.col("due_date")), "uncertainty": noted}
    return drafts, good.select(*[same.get(c, F.col(c)).alias(c) for c in tasks.columns])


# ---- reviews -----------------------------------------------------------------

#: Lengths of a review's texts, its statuses, and what republishing says.
REVIEW_LENGTHS = {"name": (3, 250), "funder": (2, 250), "summary": (20, 3000), "eligibility": (20, 5000), "notes": (10, 3000), "evidence": (30, 3000)}
REVIEW_STATUSES = ("open", "upcoming", "closed", "unannounced", "unknown")
MOST_AMOUNT, MOST_URL = 100_000_000, 2000
REPUBLISHED = "Editor reviewed and republished this program."


def review_violations(as_of: str = AS_OF) -> Column:
    """Names of the rules that a review breaks, in the rules' order."""
    c, today = F.col, F.to_date(X.now(as_of))
    inside = lambda v, least, most: F.coalesce(F.length(F.trim(v)).between(least, most), F.lit(False))
    rules = [(name, ~inside(name, *lengths)) for name, lengths in REVIEW_LENGTHS.items()]
    rules += [("url", ~(c("url").rlike("^https://") & inside("url", 9, MOST_URL))), ("status", ~c("status").isin(*REVIEW_STATUSES))]
    rules += [(a, ~c(a).between(0, MOST_AMOUNT)) for a in ("minimum", "maximum", "fee")]
    rules += [("minimum exceeds maximum", c("minimum") > c("maximum")), ("upcoming needs opening", (c("status") == "upcoming") & c("opens").isNull()), ("deadline before opening", c("deadline") <= c("opens"))]
    rules += [("passed deadline", (c("status") == "open") & (c("deadline") < today)), ("future opening", (c("status") == "open") & (c("opens") > today)), ("currency", ~c("currency").rlike("^[A-Z]{3}$"))]
    for name, known in (("categories", CATEGORIES), ("applicants", APPLICANT_TYPES)):
        rules.append((name, ~F.coalesce(F.size(name).between(1, len(known)) & (F.size(F.array_except(name, F.array(*map(F.lit, known)))) == 0), F.lit(False))))
    rules.append(("locations", F.col("places").isNull()))
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(name in ("url", "status", "currency"))), name) for name, bad in rules]))


def _bare(name) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def review_outcomes(reviews: DataFrame, opps: DataFrame, applied: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Every review with ``outcome`` and ``program``: repeated (its ``review_id`` was
    applied before), rejected (``violations``), not found, duplicate (another program has
    the name's letters or the url, or an earlier review of the set claims them), stale (the
    program has changed since the editor's ``base_version``, or an earlier review of the set
    changes it), applied. A new program's id comes from its url, so the same set makes it
    once."""
    rows = reviews.withColumn("places", location_lines(F.col("locations"))).withColumn("violations", review_violations(as_of))
    is_new = F.coalesce(F.trim("id"), F.lit("")) == ""
    rows = rows.select("*", is_new.alias("is_new"), F.when(is_new, F.concat(F.lit("review-"), F.md5("url"))).otherwise(F.col("id")).alias("program"), F.struct("reviewed_at", "review_id").alias("turn"), _bare("name").alias("bare"))
    there = opps.select(F.col("id").alias("program"), F.col("catalog_updated_at").alias("version"), F.lit(True).alias("there"))
    rows = rows.join(there, "program", "left").join(applied.select("review_id", F.lit(True).alias("before")).distinct(), "review_id", "left")
    # Names and urls that another program has: at most two owners are needed to know of one.
    claims = lambda df, who, name, url: df.select(who.alias("who"), F.explode(F.array(F.concat(F.lit("name "), name), F.concat(F.lit("url "), url))).alias("claim"))
    owned = claims(opps, F.col("id"), _bare("name"), F.col("source_url")).groupBy("claim").agg(F.min("who").alias("low"), F.max("who").alias("high"))
    mine = claims(rows, F.struct("review_id", "program"), F.col("bare"), F.col("url"))
    taken = mine.join(owned, "claim").where((F.col("low") != F.col("who.program")) | (F.col("high") != F.col("who.program"))).select("who.review_id", F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, "review_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    first = (
        F.when(flag(F.col("before")), "repeated").when(F.size("violations") > 0, "rejected").when(~F.col("is_new") & ~flag(F.col("there")), "not found").when(flag(F.col("taken")) | (F.col("is_new") & flag(F.col("there"))), "duplicate")
        .when(~F.col("is_new") & F.col("base_version").isNotNull() & (F.col("base_version") != F.col("version")), "stale")
    )
    rows = rows.withColumn("outcome", first)
    # Of the reviews left, the first for each program, and of these the first for each claim.
    left = rows.where("outcome is null")
    turns = left.groupBy("program").agg(F.min("turn").alias("first_turn"))
    leading = left.join(turns, "program").where(F.col("turn") == F.col("first_turn"))
    claimed = claims(leading, F.struct("turn", "program"), F.col("bare"), F.col("url"))
    ahead = claimed.groupBy("claim").agg(F.min("who.turn").alias("ahead"))
    late = claimed.join(ahead, "claim").where(F.col("who.turn") > F.col("ahead")).select(F.col("who.turn.review_id").alias("review_id"), F.lit(True).alias("late")).distinct()
    rows = rows.join(turns, "program", "left").join(late, "review_id", "left")
    # A new program that the set names twice is there once; the others would repeat it.
    second = F.when(F.col("turn") > F.col("first_turn"), F.when(F.col("is_new"), "duplicate").otherwise("stale")).when(flag(F.col("late")), "duplicate").otherwise("applied")
    return rows.withColumn("outcome", F.coalesce("outcome", second)).drop("turn", "first_turn", "late", "taken", "before", "version", "there", "bare")


def review_apply(reviews: DataFrame, tables: dict[str, DataFrame], as_of: str = AS_OF) -> dict[str, DataFrame]:
    """Reviews over ``tables`` opportunities, funders, categories, applicants, geographies,
    monitoring and applied -> the tables after, and ``outcomes``. Applied reviews overwrite
    their program and what hangs on it; fields of a round that the review does not give are
    emptied; archived programs are hidden; discontinued ones that are republished become
    active; a funder is known by its name in any case. Nothing of other reviews is written,
    so a set that is applied again changes nothing."""
    opps, funders = tables["opportunities"], tables["funders"]
    out = kept(review_outcomes(reviews, opps, tables["applied"], as_of), "reviews")
    yes = out.where("outcome = 'applied'")
    known = funders.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("funder_id"))
    yes = yes.withColumn("low", F.lower(F.trim("funder"))).join(known, "low", "left").withColumn("funder_new", F.col("funder_id").isNull()).withColumn("funder_id", F.coalesce("funder_id", F.concat(F.lit("f-"), F.md5("low"))))
    added = yes.where("funder_new").groupBy(F.col("funder_id").alias("id")).agg(F.min(F.trim("funder")).alias("name"))
    now = X.now(as_of)
    # What a review sets: (column of programs, value).
    sets = {
        "name": F.trim("r.name"), "summary": F.trim("r.summary"), "eligibility_notes": F.trim("r.eligibility"), "funder_id": F.col("r.funder_id"), "source_url": F.col("r.url"), "application_status": F.col("r.status"),
        "deadline": F.col("r.deadline"), "opens": F.col("r.opens"), "rolling": F.coalesce("r.rolling", F.lit(False)), "minimum_award": F.col("r.minimum"), "maximum_award": F.col("r.maximum"),
        "publication_state": F.when(F.col("r.archive"), "hidden").otherwise("published"), "verification_status": F.when(F.col("r.archive"), "archived").otherwise("verified"), "last_checked_at": now, "catalog_updated_at": now,
    }
    types = dict(opps.dtypes)
    change = yes.alias("r").select(F.col("r.program").alias("id"), F.col("r.is_new").alias("is_new"), F.struct(*[v.cast(types[c]).alias(c) for c, v in sets.items() if c in types]).alias("s"))
    rows = opps.join(change.where("not is_new").select("id", "s"), "id", "left")
    updated = rows.select(*[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in opps.columns])
    plain = {"is_demo": F.lit(False), "created_at": now}
    new = change.where("is_new").select(*[(F.col(f"s.{c}") if c in sets else F.col("id") if c == "id" else plain.get(c, F.lit(None)).cast(types[c])).alias(c) for c in opps.columns])
    ids = change.select(F.col("id").alias("opportunity_id"))
    instead = lambda table, rows: tables[table].join(ids, "opportunity_id", "left_anti").select(rows.columns).unionByName(rows)
    listed = lambda column, name: yes.select(F.col("program").alias("opportunity_id"), F.explode(F.array_distinct(column)).alias(name))
    places = yes.select(F.col("program").alias("opportunity_id"), F.explode(F.array_distinct("places")).alias("p")).select("opportunity_id", "p.country", "p.state", "p.city", F.lit("eligible").alias("rule"))
    back = yes.where("not coalesce(archive, false)").select(F.col("program").alias("opportunity_id"), F.lit(True).alias("back"))
    monitoring = tables["monitoring"].join(back, "opportunity_id", "left")
    returns = (F.col("state") == "discontinued") & F.coalesce("back", F.lit(False))
    monitoring = monitoring.select("opportunity_id", F.when(returns, "active").otherwise(F.col("state")).alias("state"), F.when(returns, F.lit(REPUBLISHED)).alias("evidence"), F.when(returns, now).alias("changed_at"))
    applied = tables["applied"].select("review_id").unionByName(yes.select("review_id"))
    return {
        "outcomes": out.select("review_id", "outcome", F.when(F.col("outcome").isin("applied", "stale"), F.col("program")).alias("program"), "violations"), "opportunities": updated.unionByName(new), "funders": funders.select("id", "name").unionByName(added),
        "categories": instead("categories", listed("categories", "category")), "applicants": instead("applicants", listed("applicants", "applicant_type")), "geographies": instead("geographies", places), "monitoring": monitoring, "applied": applied,
    }
