"""The search over programs, leads and feed results for one applicant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.functions import roles as P
from fundcat.operators import catalog as C
from fundcat.operators import leads as L
from fundcat.operators.evidence import publisher_identity
from fundcat.schema import AS_OF
from fundcat.tables import kept


@dataclass(frozen=True)
class Applicant:
    """Whom a search is for."""

    applicant_type: str
    wanted: tuple[str, ...]
    country: str = ""
    state: str = ""
    city: str = ""


@dataclass(frozen=True)
class Wish:
    """What a search is narrowed to. ``geo`` is ``all``, ``eligible`` or ``unknown``."""

    status: str = ""
    min_award: float = 0
    categories: tuple[str, ...] = ()
    geo: str = "all"


_CARD = ("id", "kind", "record_type", "title", "summary", "url", "status", "current_deadline", "maximum_award", "categories", "source_categories", "applicants", "has_places", "geo", "geo_reason", "verified", "since")
#: Roles that keep a program out of the results unless its name alone is a program's.
GATED = ("directory", "announcement", "supporting", "guidelines", "faq", "application")
UNPLACED = "Location eligibility needs checking"


def catalog_cards(cat, who: Applicant, q: str = "", as_of: str = AS_OF, wish: Wish = Wish()) -> DataFrame:
    """Visible programs that hold all terms and facets asked for and are programs by their page or name."""
    wide = C.catalog_wide(cat, as_of)
    wide = C.keyword_filter(wide, q) if q else wide
    wide = C.facet_filter(wide, wish.categories, "", wish.status, wish.min_award)
    bodies = C.latest_snapshot(cat["crawl_snapshots"], as_of).select(F.col("url").alias("source_url"), "body")
    rows = wide.join(bodies, "source_url", "left").withColumn("said", F.coalesce("body", "summary"))
    name, url, said = F.col("name"), F.col("source_url"), F.col("said")
    rows = rows.withColumn("role", X.once(P.page_role(name, url, said))).withColumn("named", X.once(P.program_name(name, url, said))).where(~F.col("role").isin(*GATED) | F.col("named")).drop("body", "said")
    spark = wide.sparkSession
    place = spark.createDataFrame([("asked", who.country or None, who.state or None, who.city or None)], "target_id string, country string, state string, city string")
    geos = cat["opportunity_geographies"]
    geo = C.geo_match(wide.select(F.lit("asked").alias("target_id"), F.col("id").alias("opportunity_id")), geos, place).select(F.col("opportunity_id").alias("id"), "geo", "geo_reason")
    placed = geos.select(F.col("opportunity_id").alias("id"), F.lit(True).alias("has_places")).distinct()
    research = (F.col("role") == "ambiguous") & (F.col("verification_status") != "verified") & ~F.col("name").rlike("(?i)" + P.PROGRAM_TITLE)
    rows = rows.join(geo, "id").join(placed, "id", "left")
    return rows.select("id", F.lit("catalog").alias("kind"), F.when(research, "research").otherwise("program").alias("record_type"), F.col("name").alias("title"), "summary", F.col("source_url").alias("url"), "status", "current_deadline", "maximum_award", "categories", F.lit(False).alias("source_categories"), "applicants", F.coalesce("has_places", F.lit(False)).alias("has_places"), "geo", "geo_reason", (F.col("verification_status") == "verified").alias("verified"), F.col("created_at").alias("since"))


def _other(rows: DataFrame, kind: str, record_type, wish: Wish) -> DataFrame:
    """Cards of rows without facts of their own: their award is not known, nor is their
    status, so they answer no search for either. Only ``categories`` may be given."""
    none = F.array().cast("array<string>")
    if wish.min_award or wish.status not in ("", "unknown"):
        rows = rows.where(F.lit(False))
    rows = rows if "categories" in rows.columns else rows.withColumn("categories", none)
    if wish.categories:
        rows = rows.where(F.arrays_overlap("categories", F.array(*map(F.lit, wish.categories))))
    return rows.select(
        F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), record_type.alias("record_type"), "title", "summary", "url", F.lit("unknown").alias("status"), F.lit(None).cast("date").alias("current_deadline"), F.lit(None).cast("double").alias("maximum_award"),
        "categories", F.lit(kind == "lead").alias("source_categories"), none.alias("applicants"), F.lit(False).alias("has_places"), F.lit("unknown").alias("geo"), F.lit(UNPLACED).alias("geo_reason"), F.lit(False).alias("verified"), "since",
    )


def lead_cards(cat, q: str = "", wish: Wish = Wish()) -> DataFrame:
    """Leads that no program covers, one a url, whose page is a program's or unclear, with
    the categories of their source. Each term is in the title, the summary, or the name or
    categories of the source."""
    leads = L.unaliased_leads(cat["crawl_candidates"], cat["opportunities"], cat["opportunity_source_urls"], cat["catalog_monitoring"])
    leads = L.lead_dedupe(leads, cat["crawl_snapshots"])
    sources = cat["source_registry"].select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.array_compact(F.array("c1", "c2")).alias("categories"))
    rows = leads.select("id", "url", "title", "snapshot_id", "source_id", F.col("fetched_at").alias("since")).join(cat["crawl_snapshots"].select(F.col("id").alias("snapshot_id"), "body"), "snapshot_id").join(sources, "source_id", "left")
    rows = rows.withColumns({"categories": F.coalesce("categories", F.array().cast("array<string>")), "summary": F.substring("body", 1, 600)})
    said = F.lower(F.concat_ws("\n", "title", "summary", "source_name", F.array_join("categories", " ")))
    for term in q.lower().split():
        rows = rows.where(F.contains(said, F.lit(term)))
    rows = rows.withColumn("role", X.once(P.page_role(F.col("title"), F.col("url"), F.col("body")))).where("role in ('program', 'ambiguous')")
    return _other(rows, "lead", F.when(F.col("role") == "program", "program").otherwise("research"), wish)


def external_cards(results: DataFrame, opps: DataFrame, aliases: DataFrame, records: DataFrame, q: str = "", wish: Wish = Wish()) -> DataFrame:
    """``results(provider, external_id, source_url, title, content, fetched_at)`` that the
    catalog does not have and that hold all terms."""
    rows = L.external_unpublished(results, opps, aliases, records)
    for term in q.lower().split():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "content")), F.lit(term)))
    rows = rows.select(F.concat_ws(":", "provider", "external_id").alias("id"), F.col("source_url").alias("url"), "title", F.col("content").alias("summary"), F.col("fetched_at").alias("since"))
    return _other(rows, "external", F.lit("program"), wish)


def collapse(cards: DataFrame, aliases: DataFrame) -> DataFrame:
    """One card per program: urls that are aliases of a shown program stand for it. A
    verified program goes before others, these before leads and results, then the
    earliest. Cards of one identity are reduced as they meet, none is gathered."""
    shown = cards.where("kind = 'catalog'").select(F.col("id").alias("opportunity_id"), publisher_identity(F.col("url")).alias("program_key"))
    named = aliases.select("opportunity_id", publisher_identity(F.col("url")).alias("own_key")).join(shown, "opportunity_id").groupBy("own_key").agg(F.min("program_key").alias("program_key"))
    rows = cards.withColumn("own_key", publisher_identity(F.col("url"))).join(named, "own_key", "left").withColumn("key", F.coalesce("program_key", "own_key")).drop("own_key", "program_key")
    order = F.struct(F.when(F.col("kind") != "catalog", 2).when(F.col("verified"), 0).otherwise(1), F.col("since"), F.col("id"))
    return rows.groupBy("key").agg(F.min_by(F.struct(*_CARD), order).alias("c")).select("c.*")


def unified_search(cat, results: DataFrame, who: Applicant, q: str = "", record_type: str = "program", sort: str = "recommended", page: int = 1, size: int = 12, as_of: str = AS_OF, wish: Wish = Wish()) -> DataFrame:
    """A page of programs or of research pages for an applicant, with the numbers of both
    on each row, those of programs open to the place, and of cards of the kind asked for
    whose place is unknown. Programs that are not open to the applicant's place are left
    out. Programs earn credit for the categories of the wish; leads and results name the
    applicant's own. A page past the end is the last one."""
    cards = catalog_cards(cat, who, q, as_of, wish).select(*_CARD).unionByName(lead_cards(cat, q, wish).select(*_CARD)).unionByName(external_cards(results, cat["opportunities"], cat["opportunity_source_urls"], cat["provider_records"], q, wish).select(*_CARD))
    # Cards are asked for aliases, totals and the page: they are written, or each would read all texts.
    cards = kept(cards, "search-cards")
    one = collapse(cards, cat["opportunity_source_urls"])
    asked = one.withColumns({"applicant_type": F.lit(who.applicant_type), "wanted": F.when(F.col("kind") == "catalog", F.array(*map(F.lit, wish.categories)).cast("array<string>")).otherwise(F.array(*map(F.lit, who.wanted)).cast("array<string>"))})
    rows = C.judged(asked, q).withColumnsRenamed({"title": "name", "since": "fetched"})
    program, asked_for = F.col("record_type") == "program", F.col("record_type") == record_type
    stays = (F.col("geo") != "excluded") & (F.lit(not who.country or wish.geo == "all") | (F.col("geo") == wish.geo))
    totals = rows.agg(
        F.count_if(stays & program).alias("programs"), F.count_if(stays & (F.col("record_type") == "research")).alias("research"), F.count_if(stays & asked_for).alias("total"),
        F.count_if(program & (F.col("geo") == "eligible")).alias("eligible_programs"), F.count_if(asked_for & (F.col("geo") == "unknown") & F.lit(bool(who.country))).alias("location_unknown"),
    )
    # No page needs more rows than the pages up to it hold, so only these are numbered.
    order = C.result_order(sort)
    best = rows.where(stays & asked_for).orderBy(*order).limit(page * size).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    best = best.join(F.broadcast(totals)).withColumn("page", F.least(F.lit(page), last).cast("long"))
    return best.where(F.ceil(F.col("place") / size) == F.col("page")).drop("place", "total")
