"""Registered queries of the catalog operators, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.functions import roles as P
from fundcat.functions.urls import canonical_url, is_safe
from fundcat.operators import catalog as C
from fundcat.operators import reports as R
from fundcat.plans import evidence, leads, publication, requests  # noqa: F401  register their queries
from fundcat.plans.base import HOST, KEY, NOW, ORACLES, QUERIES, TODAY, VISIBLE, query  # noqa: F401
from fundcat.schema import CATEGORIES, FOCUS
from fundcat.sources.pages import page_parse
from fundcat.streaming import monitor as M

# ---- shared pieces of the oracles ---------------------------------------------

STATUS = f"""case when m.state = 'discontinued' then 'discontinued' when o.opens > {TODAY} then 'upcoming'
 when (o.deadline < {TODAY} or o.application_status = 'closed') and o.recurrence in ('annual', 'recurring') then 'between_rounds'
 when o.deadline < {TODAY} then 'round_ended' when o.application_status = 'upcoming' and o.opens <= {TODAY} then 'unknown' else o.application_status end"""
WIDE = f"""wide as (select o.*, f.name as funder, {STATUS} as status,
 case when o.deadline >= {TODAY} then o.deadline end as current_deadline, case when o.deadline < {TODAY} then o.deadline end as previous_deadline,
 o.last_checked_at >= {NOW} - interval 90 day as fresh,
 coalesce((select list(category order by category) from opportunity_categories b where b.opportunity_id = o.id), []) as categories,
 coalesce((select list(applicant_type order by applicant_type) from opportunity_applicant_types b where b.opportunity_id = o.id), []) as applicants,
 coalesce((select list(coalesce(city, state, country, 'No location restriction published') order by coalesce(city, state, country, 'No location restriction published')) from opportunity_geographies b where b.opportunity_id = o.id), []) as locations,
 (select title from crawl_snapshots s where s.url = o.source_url and s.fetched_at <= {NOW} order by fetched_at desc, s.id desc limit 1) as evidence_title
 from opportunities o left join funders f on f.id = o.funder_id left join catalog_monitoring m on m.opportunity_id = o.id where {VISIBLE})"""
RANK = "case status when 'open' then 0 when 'upcoming' then 1 when 'between_rounds' then 2 when 'unknown' then 3 when 'unannounced' then 4 when 'round_ended' then 5 when 'closed' then 6 when 'discontinued' then 7 else 8 end"
HOURS = f"case when opens between {TODAY} and {TODAY} + 30 then 6 when application_status = 'closed' then case when recurrence in ('annual', 'recurring') then 24 else 168 end when deadline between {TODAY} and {TODAY} + 30 then 6 else 24 end"
CARD = "select id, name, funder, status, current_deadline, previous_deadline, fresh, array_to_string(categories, ',') as categories, array_to_string(applicants, ',') as applicants, array_to_string(locations, ',') as locations, evidence_title, maximum_award"


def card(df: DataFrame) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("categories", "applicants", "locations")]
    return df.select("id", "name", "funder", "status", "current_deadline", "previous_deadline", "fresh", *joined, "evidence_title", "maximum_award")


# ---- projections, filters ------------------------------------------------------


@query("visible_programs", f"select id, name, source_url from opportunities o where {VISIBLE}")
def visible_programs(c):
    return C.visible_programs(c["opportunities"]).select("id", "name", "source_url")


@query("availability", f"select o.id, {STATUS} as status from opportunities o left join catalog_monitoring m on m.opportunity_id = o.id")
def availability(c):
    return C.availability(c["opportunities"], c["catalog_monitoring"]).select("id", "status")


@query("deadline_split", f"select id, case when deadline >= {TODAY} then deadline end as current_deadline, case when deadline < {TODAY} then deadline end as previous_deadline, last_checked_at >= {NOW} - interval 90 day as fresh from opportunities", texts=('current_deadline', 'previous_deadline'))
def deadline_split(c):
    return C.deadline_split(c["opportunities"]).select("id", "current_deadline", "previous_deadline", "fresh")


@query(
    "card_labels",
    f"""with {WIDE}, l as (select *, '$' || format('{{:,}}', cast(floor(minimum_award + 0.5) as bigint)) as lo, '$' || format('{{:,}}', cast(floor(maximum_award + 0.5) as bigint)) as hi from wide)
 select id, case when minimum_award = maximum_award and maximum_award <> 0 then hi when minimum_award <> 0 and maximum_award <> 0 then lo || '–' || hi when maximum_award is not null then 'Up to ' || hi else 'Unknown' end as award_label,
 case when status = 'open' and rolling then 'Open—rolling' else case status when 'open' then 'Open' when 'upcoming' then 'Upcoming' when 'between_rounds' then 'Between rounds' when 'round_ended' then 'Closed round' when 'closed' then 'Closed round' when 'unannounced' then 'Unknown' when 'unknown' then 'Unknown' when 'discontinued' then 'Discontinued' else 'Status unknown' end end as status_label from l""",
)
def card_labels(c):
    return C.card_labels(C.catalog_wide(c)).select("id", "award_label", "status_label")


@query("keyword_filter", f"with {WIDE} {CARD} from wide where contains(lower(name || ' ' || summary || ' ' || coalesce(funder, '') || ' ' || eligibility_notes || ' ' || array_to_string(categories, ' ')), 'grant') and (contains(lower(summary), 'women') or contains(lower(name), 'women'))", texts=('current_deadline', 'previous_deadline'))
def keyword_filter(c):
    return card(C.keyword_filter(C.catalog_wide(c), "grant women"))


@query("facet_filter", f"with {WIDE} {CARD} from wide where list_has_any(categories, ['Music', 'Research']) and list_contains(applicants, 'nonprofit') and maximum_award >= 920", texts=('current_deadline', 'previous_deadline'))
def facet_filter(c):
    return card(C.facet_filter(C.catalog_wide(c), ("Music", "Research"), "nonprofit", min_award=920))


@query("focus_match", "select id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(summary, '\\b(?:{FOCUS[t]})\\b', 'i') then '{t}' end" for t in sorted(FOCUS)) + "], lambda x: x is not null), ',') as focus from opportunities")
def focus_match(c):
    return C.focus_match(c["opportunities"], "summary").select("id", F.array_join("focus", ",").alias("focus"))


@query(
    "suggested_filter",
    f"""with {WIDE} select distinct p.workspace_id, w.id from wide w join profiles p on list_contains(w.applicants, p.applicant_type) join profile_categories pc on pc.workspace_id = p.workspace_id and list_contains(w.categories, pc.category)
 where w.status in ('open', 'upcoming') and exists (select 1 from opportunity_geographies g where g.opportunity_id = w.id and g.rule = 'eligible' and (g.country is null or lower(g.country) = lower(p.country)) and (g.state is null or lower(g.state) = lower(p.state)) and (g.city is null or lower(g.city) = lower(p.city)))""",
)
def suggested_filter(c):
    return C.suggested_filter(C.catalog_wide(c), c["profiles"], c["profile_categories"], c["opportunity_geographies"])


# ---- joins ---------------------------------------------------------------------


@query("catalog_wide", f"with {WIDE} {CARD} from wide", texts=('current_deadline', 'previous_deadline'))
def catalog_wide(c):
    return card(C.catalog_wide(c))


@query("latest_snapshot", f"select url, id, title from (select *, row_number() over (partition by url order by fetched_at desc, id desc) as n from crawl_snapshots where fetched_at <= {NOW}) where n = 1")
def latest_snapshot(c):
    return C.latest_snapshot(c["crawl_snapshots"]).select("url", "id", "title")


@query(
    "snapshot_asof",
    """select e.event_id, e.url, case when s.fetched_at >= e.ts - interval 24 hour then s.id end as snapshot_id from asof_events e left join lateral (select id, fetched_at from crawl_snapshots s where s.url = e.url and s.fetched_at <= e.ts order by fetched_at desc, id desc limit 1) s on true""", texts=('snapshot_id',))
def snapshot_asof(c):
    return C.snapshot_asof(c["asof_events"], c["crawl_snapshots"])


@query("current_workspace", "select m.user_id, m.workspace_id, p.name, p.applicant_type from (select *, row_number() over (partition by user_id order by created_at, workspace_id) as n from workspace_members) m left join profiles p on p.workspace_id = m.workspace_id where n = 1")
def current_workspace(c):
    return C.current_workspace(c["workspace_members"], c["profiles"]).select("user_id", "workspace_id", "name", "applicant_type")


@query("application_lookup", "select o.id, coalesce((select arg_min(a.id, (a.created_at, a.id)) from applications a where a.opportunity_id = o.id), (select arg_min(a.id, (a.created_at, a.id)) from applications a where a.source_url = o.source_url)) as application_id from opportunities o")
def application_lookup(c):
    return C.application_lookup(c["opportunities"], c["applications"])


@query(
    "geo_match",
    """with targets as (select distinct coalesce(country, '') || '|' || coalesce(state, '') || '|' || coalesce(city, '') as target_id, country, state, city from profiles),
 r as (select t.target_id, g.opportunity_id, g.rule, g.seq, coalesce(g.country, g.state, g.city) is not null as named,
  case when g.city is not null then 'Available in ' || g.city when g.state is not null then 'Available in ' || g.state when gc = '' then 'Accepts applicants worldwide' when gc = 'United States' then 'Accepts applicants nationwide' else 'Available in ' || gc end as fit,
  case when (gc <> '' and t.country is not null and lower(gc) <> lower(t.country)) or (g.state is not null and t.state is not null and lower(g.state) <> lower(t.state)) or (g.city is not null and t.city is not null and lower(g.city) <> lower(t.city)) then 'different'
   when (gc <> '' and t.country is null) or (g.state is not null and t.state is null) or (g.city is not null and t.city is null) then 'unknown' else 'matches' end as rel
  from (select *, case when country is null or lower(country) in ('worldwide', 'global', 'international') then '' else country end as gc from opportunity_geographies) g cross join targets t),
 s as (select target_id, opportunity_id, case when bool_or(rule = 'excluded' and rel = 'matches') then 'excluded' when bool_or(rule = 'eligible' and named and rel = 'matches') and not bool_or(rule = 'excluded' and rel = 'unknown') then 'eligible'
 when bool_or(rule = 'eligible' and named) and not bool_or(rule = 'eligible' and named and rel <> 'different') then 'excluded' else 'unknown' end as geo, arg_min(fit, seq) filter (where rule = 'eligible' and named and rel = 'matches') as fit from r group by 1, 2)
 select target_id, opportunity_id, geo, case geo when 'eligible' then fit when 'excluded' then 'Not available in this location' else 'Location eligibility needs checking' end as geo_reason from s""",
)
def geo_match(c):
    places = c["profiles"].select(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in ("country", "state", "city")]).alias("target_id"), "country", "state", "city").distinct()
    geos = c["opportunity_geographies"]
    pairs = geos.select("opportunity_id").distinct().join(places.select("target_id"))  # every place is asked about every program
    return C.geo_match(pairs, geos, places)


TERMS = "music women"


MATCHED = f"""{WIDE}, rel as (select p.workspace_id, g.opportunity_id, g.seq, g.rule, coalesce(g.country, g.state, g.city) is not null as named,
  case when g.city is not null then 'Available in ' || g.city when g.state is not null then 'Available in ' || g.state when gc = '' then 'Accepts applicants worldwide' when gc = 'United States' then 'Accepts applicants nationwide' else 'Available in ' || gc end as fit,
  case when (gc <> '' and p.country is not null and gc <> p.country) or (g.state is not null and p.state is not null and g.state <> p.state) or (g.city is not null and p.city is not null and g.city <> p.city) then 'different'
   when (gc <> '' and p.country is null) or (g.state is not null and p.state is null) or (g.city is not null and p.city is null) then 'unknown' else 'matches' end as rel
  from (select *, case when country is null or country = 'Worldwide' then '' else country end as gc from opportunity_geographies) g cross join profiles p),
 geo as (select workspace_id, opportunity_id, case when bool_or(rule = 'excluded' and rel = 'matches') then 'excluded' when bool_or(rule = 'eligible' and named and rel = 'matches') and not bool_or(rule = 'excluded' and rel = 'unknown') then 'eligible'
 when bool_or(rule = 'eligible' and named) and not bool_or(rule = 'eligible' and named and rel <> 'different') then 'excluded' else 'unknown' end as geo, arg_min(fit, seq) filter (where rule = 'eligible' and named and rel = 'matches') as fit from rel group by 1, 2),
 pairs as (select w.*, p.workspace_id, p.applicant_type, g.geo, g.fit, list_sort(list_intersect(w.categories, i.wanted)) as shared, list_contains(w.applicants, p.applicant_type) as fits
  from wide w join (select workspace_id, list(category) as wanted from profile_categories group by 1) i on list_has_any(w.categories, i.wanted) join profiles p on p.workspace_id = i.workspace_id left join geo g on g.workspace_id = p.workspace_id and g.opportunity_id = w.id),
 matched as (select workspace_id, id, name, status, current_deadline, cast(len(shared) + case when fits then 1 else 0 end + case when geo = 'eligible' then 1 else 0 end as bigint) as matches,
  cast(case when len(applicants) > 0 and not fits then 1 else 0 end + case when geo = 'excluded' then 1 else 0 end as bigint) as conflicts,
  'Matches ' || shared[1] || case when len(shared) > 1 then '; Matches ' || shared[2] else '' end || case when len(applicants) = 0 then '' when fits then '; Matches your applicant type' else '; Applicant type may not fit' end
   || case geo when 'eligible' then '; ' || fit when 'excluded' then '; Location may not fit' else '; Location eligibility needs checking' end || case when len(applicants) = 0 then '; Eligibility needs checking' else '' end as reasons,
  cast(3 * (case when contains(lower(name), 'music') then 1 else 0 end + case when contains(lower(name), 'women') then 1 else 0 end) + case when contains(lower(summary), 'music') then 1 else 0 end + case when contains(lower(summary), 'women') then 1 else 0 end as bigint) as relevance from pairs)"""


@query("profile_match", f"with {MATCHED} select conflicts, matches, relevance, status, reasons, count(*) as n, count(distinct workspace_id) as workspaces, count(distinct id) as programs from matched group by all")
def profile_match(c):
    members = C.profile_classes(c["profiles"], c["profile_categories"])
    programs = C.program_kinds(C.catalog_wide(c), c["opportunity_geographies"], TERMS)
    return C.profile_totals(programs, C.kind_match(programs, members, c["opportunity_geographies"]), members)


@query("rank_results", f"with {MATCHED}, r as (select workspace_id, id, reasons, row_number() over (partition by workspace_id order by conflicts, {RANK}, matches desc, relevance desc, current_deadline asc nulls last, name, id) as rank from matched) select workspace_id, id, reasons, cast(rank as int) as rank from r where rank <= 10")
def rank_results(c):
    members = C.profile_classes(c["profiles"], c["profile_categories"])
    matched = C.class_match(C.catalog_wide(c), members, c["opportunity_geographies"], TERMS, top=10)
    return C.rank_results(matched, members).select("workspace_id", "id", F.array_join("reasons", "; ").alias("reasons"), "rank")


# ---- aggregations --------------------------------------------------------------


@query("category_coverage", "select c.category, count(distinct o.id) as total from opportunity_categories c join opportunities o on o.id = c.opportunity_id where not o.is_demo and o.publication_state = 'published' and o.verification_status <> 'archived' and not exists (select 1 from catalog_monitoring m where m.opportunity_id = o.id and m.state = 'discontinued') group by 1")
def category_coverage(c):
    return R.category_coverage(c["opportunities"], c["catalog_monitoring"], c["opportunity_categories"])


@query("discovery_counts", f"with {WIDE} select s.workspace_id, count(*) as saved, count(*) filter (where w.deadline between {TODAY} and {TODAY} + 30 and w.status not in ('closed', 'discontinued', 'between_rounds', 'round_ended')) as deadlines, (select count(*) from wide) as catalog from saved_opportunities s join wide w on w.id = s.opportunity_id group by 1")
def discovery_counts(c):
    return R.discovery_counts(C.catalog_wide(c), c["saved_opportunities"])


@query("completeness", f"with {WIDE} select count(*) as programs, count(*) filter (where deadline is not null or rolling) as deadline, count(maximum_award) as maximum, count(minimum_award) as minimum, count(*) filter (where application_status <> 'unknown') as status, count(*) filter (where eligibility_notes not in ('', 'Unknown')) as eligibility, count(recurrence) as recurrence, count(opens) as opens, count(*) filter (where len(applicants) > 0) as applicants, count(*) filter (where len(categories) > 0) as categories from wide")
def completeness(c):
    return R.completeness(C.catalog_wide(c))


@query("monitor_stats", f"select count(*) as programs, count(*) filter (where m.state = 'discontinued') as archived, count(*) filter (where m.consecutive_failures >= 3) as failing, count(*) filter (where m.last_success_at is null) as never_checked from opportunities o left join catalog_monitoring m on m.opportunity_id = o.id where {VISIBLE}")
def monitor_stats(c):
    return R.monitor_stats(c["opportunities"], c["catalog_monitoring"])


@query("stage_counts", "select workspace_id, coalesce(stage, 'all') as stage, count(*) as n from applications where not archived group by rollup(workspace_id, stage) having workspace_id is not null")
def stage_counts(c):
    return R.stage_counts(c["applications"])


@query("application_list", "select a.id, a.workspace_id, a.stage, coalesce(t.tasks, 0) as tasks, coalesce(t.done, 0) as done, coalesce(o.deadline, a.target_date) as due from applications a left join (select application_id, count(*) as tasks, count(*) filter (where completed) as done from grant_tasks where not deleted group by 1) t on t.application_id = a.id left join opportunities o on o.id = a.opportunity_id where not a.archived", texts=("due",))
def application_list(c):
    return R.application_list(c["applications"], c["grant_tasks"], c["opportunities"])


@query("budget_totals", "select application_id, cast(sum(a) as bigint) as cost_cents, cast(sum(b) as bigint) as requested_cents, cast(sum(a - b) as bigint) as other_cents from (select application_id, cast(floor(cost * 100 + 0.5) as bigint) as a, cast(floor(requested * 100 + 0.5) as bigint) as b from application_preparation where not archived and kind = 'budget') group by 1")
def budget_totals(c):
    return R.budget_totals(c["application_preparation"])


@query("open_tasks", "with t as (select t.id, a.workspace_id, t.due from grant_tasks t join applications a on a.id = t.application_id where not t.completed and not t.deleted and ((not a.archived and a.stage not in ('awarded', 'declined', 'withdrawn')) or exists (select 1 from saved_opportunities s where s.workspace_id = a.workspace_id and s.opportunity_id = a.opportunity_id))) select id, workspace_id, due, cast(row_number() over (partition by workspace_id order by due asc nulls last, id) as int) as place from t", texts=('due',))
def open_tasks(c):
    return R.open_tasks(c["grant_tasks"], c["applications"], c["saved_opportunities"])


@query("source_coverage", f"select s.id, s.enabled, coalesce(n.urls, 0) as urls, coalesce(n.snapshots, 0) as snapshots from crawl_sources s left join (select {HOST.format('url')} as domain, count(distinct url) as urls, count(*) as snapshots from crawl_snapshots group by 1) n on n.domain = s.domain")
def source_coverage(c):
    return R.source_coverage(c["crawl_sources"], c["crawl_snapshots"])


@query("crawl_summary", "select run, count(*) as pages, count(*) filter (where outcome = 'failed') as failed, count(distinct source_id) as sources, (select count(*) from crawl_candidates where status = 'pending' and kind <> 'domain') as backlog from crawl_visits group by 1")
def crawl_summary(c):
    return R.crawl_summary(c["crawl_visits"], c["crawl_candidates"])


@query("source_health", "select s.id, s.enabled, v.last_success, v.failures, v.visits from crawl_sources s left join (select source_id, max(ts) filter (where outcome <> 'failed') as last_success, count(*) filter (where outcome = 'failed') as failures, count(*) as visits from crawl_visits group by 1) v on v.source_id = s.id")
def source_health(c):
    return R.source_health(c["crawl_sources"], c["crawl_visits"])


@query("evidence_fingerprint", "select url, string_agg(content_hash, '|' order by fetched_at, id) as fingerprint from crawl_snapshots group by 1")
def evidence_fingerprint(c):
    return R.evidence_fingerprint(c["crawl_snapshots"])


# ---- windows, sorts, sets ------------------------------------------------------


@query("snapshot_changes", "select id, url, case when n = 1 then 'new' else 'changed' end as kind, cast(before as varchar) as before, md5(substr(b, 1, 12000)) as previous from (select *, row_number() over w as n, lag(content_hash) over w as h, lag(extractor) over w as e, lag(id) over w as before, lag(body) over w as b from crawl_snapshots window w as (partition by url order by fetched_at, id)) where n = 1 or content_hash <> h or extractor <> e")
def snapshot_changes(c):
    return R.snapshot_changes(c["crawl_snapshots"]).select("id", "url", "kind", F.col("before").cast("string").alias("before"), F.md5("previous_excerpt").alias("previous"))


@query(
    "enrichment_order",
    f"""with s as (select id, {HOST.format('source_url')} as source, last_checked_at, case when deadline between {TODAY} and {TODAY} + 30 then 8 else 0 end + case when application_status = 'unknown' then 4 else 0 end + case when deadline is null and not rolling then 2 else 0 end + case when maximum_award is null then 1 else 0 end + case when eligibility_notes in ('', 'Unknown') then 1 else 0 end as score from opportunities o where {VISIBLE})
 select id, source, score, cast(row_number() over (partition by source order by score desc, last_checked_at asc nulls first, id) as int) as turn from s""",
)
def enrichment_order(c):
    return R.enrichment_order(c["opportunities"])


@query(
    "frontier_select",
    f"""with d as (select id, {HOST.format('source_url')} as source, last_checked_at from opportunities o where {VISIBLE} and {NOW} - ({HOURS}) * interval 1 hour >= last_checked_at),
 t as (select *, row_number() over (partition by source order by last_checked_at, id) as turn from d) select id, source, cast(turn as int) as turn from t where turn <= 50 order by turn, last_checked_at, id limit 200""",
)
def frontier_select(c):
    return R.frontier_select(c["opportunities"], c["catalog_monitoring"])


@query("catalog_search", f"with {WIDE} select id, name, status, current_deadline, (select count(*) from wide) as total from wide order by least({RANK}, 5), current_deadline asc nulls last, name, id limit 12 offset 12", texts=('current_deadline',))
def catalog_search(c):
    return C.catalog_search(C.catalog_wide(c), page=2).select("id", "name", "status", "current_deadline", "total")


@query("paged_total", f"with {WIDE} select id, maximum_award, (select count(*) from wide) as total from wide order by maximum_award desc nulls last, name, id limit 12")
def paged_total(c):
    return C.catalog_search(C.catalog_wide(c), "amount").select("id", "maximum_award", "total")


@query("saved_list", f"with {WIDE} select s.workspace_id, w.id, w.name, w.current_deadline, cast(row_number() over (partition by s.workspace_id order by w.current_deadline asc nulls last, w.name, w.id) as int) as place from saved_opportunities s join wide w on w.id = s.opportunity_id", texts=('current_deadline',))
def saved_list(c):
    return C.saved_list(C.catalog_wide(c), c["saved_opportunities"]).select("workspace_id", "id", "name", "current_deadline", "place")


@query("identity_collapse", f"select id, source_url from (select *, row_number() over (partition by source_url order by case when verification_status = 'verified' then 0 else 1 end, created_at, id) as n from opportunities o where {VISIBLE}) where n = 1")
def identity_collapse(c):
    return C.identity_collapse(C.visible_programs(c["opportunities"])).select("id", "source_url")


TWINS = f"""k as (select id, k, {KEY} as key, regexp_replace(source_url, '/+$', '') as url, regexp_replace(regexp_replace(source_url, '/+$', ''), '/(apply-now|application)$', '') as parent from opportunities o), f as (select key, min(k) as n from k group by 1), u as (select url, min(k) as n from k group by 1),
 d as (select k.id, coalesce(case when f.n <> k.k then f.n end, case when k.parent <> k.url and u.n <> k.k then u.n end) as first_k from k join f on f.key = k.key left join u on u.url = k.parent)"""


@query("duplicate_programs", f"with {TWINS} select id, 'o' || cast(first_k as string) as first_id from d where first_k is not null")
def duplicate_programs(c):
    return C.duplicate_programs(c["opportunities"])


@query("published_urls", "select url from opportunity_source_urls a join opportunities o on o.id = a.opportunity_id where publication_state = 'published' and merged_into is null union select source_url from opportunities where publication_state = 'published' and merged_into is null")
def published_urls(c):
    return C.published_urls(c["opportunities"], c["opportunity_source_urls"])


@query(
    "merge_closure",
    "select c.id, c.target, cast(c.hops as int) as hops from (with recursive r(id, target, hops) as (select id, merged_into, 1 from opportunities where merged_into is not null union all select r.id, o.merged_into, r.hops + 1 from r join opportunities o on o.id = r.target where o.merged_into is not null and r.hops < 21) select id, case when hops <= 20 then target end as target, case when hops <= 20 then hops end as hops, row_number() over (partition by id order by r.hops desc) as n from r) c where n = 1", texts=('hops',))
def merge_closure(c):
    return C.merge_closure(c["opportunities"])


@query("prune_snapshots", f"select id, url, fetched_at from crawl_snapshots s where fetched_at < {NOW} - interval 10 day and id not in (select snapshot_id from snapshot_refs) and not exists (select 1 from opportunities o where o.source_url = s.url) order by fetched_at, id limit 500")
def prune_snapshots(c):
    return R.prune_snapshots(c["crawl_snapshots"], c["opportunities"], c["snapshot_refs"], keep_days=10)


_LOGS = {
    "visit": ("crawl_visits", "ts", "outcome", "opportunity_id"), "saved": ("saved_opportunities", "saved_at", "opportunity_id", "workspace_id"), "application": ("applications", "created_at", "stage", "id"), "suggestion": ("contributions", "created_at", "field", "id"),
    "field": ("catalog_field_history", "created_at", "field", "opportunity_id"), "research": ("research_ledger", "created_at", "status", "topic_key"), "reconcile": ("reconcile_events", "run_id", "action", "detail"), "search": ("search_jobs", "created_at", "status", "id"),
    "candidate": ("crawl_candidates", "created_at", "kind", "id"), "publication": ("publication_runs", "processed_at", "outcome", "candidate_id"), "evidence": ("evidence_pages", "fetched_at", "association", "opportunity_id"),
}


@query("activity_feed", "select * from (" + " union all ".join(f"select cast({ts} as timestamp) as ts, '{name}:' || cast({what} as varchar) as kind, cast({ref} as varchar) as ref from {view}" for name, (view, ts, what, ref) in _LOGS.items()) + ") order by ts desc, kind, ref limit 200")
def activity_feed(c):
    return R.activity_feed({name: (c[view].withColumn("ref", F.col(ref)), ts, what) for name, (view, ts, what, ref) in _LOGS.items()})


@query("attention_queue", f"with {TWINS.replace('from opportunities o)', f'from opportunities o where {VISIBLE})')} select id, 'duplicate' as kind, 'o' || cast(first_k as string) as detail from d where first_k is not null union all select opportunity_id, 'unavailable', cast(consecutive_failures as string) from catalog_monitoring where consecutive_failures >= 3 union all select opportunity_id, 'locked', field from catalog_fields where state = 'locked_conflict' union all select cast(min(id) as string), 'domain', {HOST.format('url')} from crawl_candidates where status = 'pending' and kind = 'domain' group by 3")
def attention_queue(c):
    return R.attention_queue(c["opportunities"], c["catalog_monitoring"], c["catalog_fields"], c["crawl_candidates"])


# ---- scalars -------------------------------------------------------------------


@query("program_key", f"select id, {KEY} as key from opportunities")
def program_key(c):
    return R.scalars(c["opportunities"], c["crawl_snapshots"]).select("id", "key")


@query("check_hours", f"select id, {HOURS} as hours from opportunities")
def check_hours(c):
    return R.scalars(c["opportunities"], c["crawl_snapshots"]).select("id", "hours")


@query("backoff_next", f"select opportunity_id, cast(least(168, pow(2, least(consecutive_failures, 7))) as int) as hours, cast(least(86400, 300 * pow(2, least(consecutive_failures, 8))) as bigint) as search_seconds, {NOW} + cast(least(86400, 900 * pow(2, least(consecutive_failures, 6))) as bigint) * interval 1 second as next_feed from catalog_monitoring")
def backoff_next(c):
    n = F.col("consecutive_failures")
    next_feed = F.timestamp_seconds(F.unix_seconds(X.now()) + X.backoff_seconds(n, "feed"))
    return c["catalog_monitoring"].select("opportunity_id", X.backoff_hours(n).alias("hours"), X.backoff_seconds(n, "search").alias("search_seconds"), next_feed.alias("next_feed"))


@query("source_date", "select id, coalesce(try_cast(regexp_extract(raw, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1) as date), cast(try_strptime(regexp_extract(raw, '^\\s*(\\d{1,2}/\\d{1,2}/\\d{4})', 1), '%m/%d/%Y') as date)) as day from date_texts", texts=("day",))
def source_date(c):
    return c["date_texts"].select("id", X.source_date(F.col("raw")).alias("day"))


@query("parse_amount", r"""select id, case when v <= 999999999999 then v end as amount from (select id, cast(nullif(replace(regexp_extract(body, '\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', ''), '') as double)
 * case lower(regexp_extract(body, '(?i)[0-9]\s*(million|thousand|billion|k|m)(?:[^A-Za-z]|$)', 1)) when 'k' then 1e3 when 'thousand' then 1e3 when 'm' then 1e6 when 'million' then 1e6 when 'billion' then 1e9 else 1 end as v from crawl_snapshots where contains(body, '$'))""")
def parse_amount(c):
    return R.page_scalars(c["crawl_snapshots"].where(F.col("body").contains("$"))).select("id", "amount")


@query("word_limit", "select id, cast(case when t = '' then 0 else len(string_split_regex(t, '[ \n\r\t]+')) end as int) as words, case when t = '' then false else len(string_split_regex(t, '[ \n\r\t]+')) > 250 end as over from (select id, regexp_replace(body, '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g') as t from crawl_snapshots)")
def word_limit(c):
    return R.page_scalars(c["crawl_snapshots"]).select("id", "words", (F.col("words") > 250).alias("over"))


def _candidate_pages(c):
    """Candidates with the text of their snapshot: every kind of title and path."""
    return c["crawl_candidates"].select("id", "url", F.col("title").alias("lead"), "snapshot_id").join(c["crawl_snapshots"].select(F.col("id").alias("snapshot_id"), "title", "body"), "snapshot_id")


PAGES = "pages_ as (select c.id, c.url, c.title as lead, s.title, s.body from crawl_candidates c join crawl_snapshots s on s.id = c.snapshot_id)"


@query("page_role", f"with {PAGES} select id, {P.role_sql('title', 'url', 'body')} as role from pages_")
def page_role(c):
    return _candidate_pages(c).select("id", P.page_role(F.col("title"), F.col("url"), F.col("body")).alias("role"))


@query("classify_candidate", f"with {PAGES}, r as (select *, {P.role_sql('title', 'url', 'body')} as role from pages_) select id, {P.classify_sql('title', 'url', 'body', 'role')} as reason from r")
def classify_candidate(c):
    return _candidate_pages(c).select("id", P.classify_candidate(F.col("title"), F.col("url"), F.col("body")).alias("reason"))


@query("schedule_day", "select id, cast(case when hour(l) < 6 then cast(l as date) - 1 else cast(l as date) end as date) as day from (select id, (ts at time zone 'UTC') at time zone 'America/New_York' as l from crawl_visits)", texts=('day',))
def schedule_day(c):
    return c["crawl_visits"].select("id", X.schedule_day(F.col("ts")).alias("day"))


@query(
    "search_intent",
    """with t as (select *, list_filter(regexp_extract_all(lower(q || ' ' || category), '[a-z0-9]{3,30}'), lambda x: not list_contains(['and', 'for', 'the', 'with'], x)) as w from search_requests), d as (select *, list_filter(w, lambda x, i: list_position(w, x) = i) as u from t), s as (select *, array_to_string(list_sort(u[1:12]), ' ') as tokens from d)
 select conv_id, turn, tokens, sha256(tokens || chr(10) || category || chr(10) || lower(coalesce(country, '') || '|' || coalesce(state, '') || '|') || chr(10) || array_to_string(list_sort(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda x: x <> '')), ' ') || chr(10) || applicant || chr(10) || status || chr(10) || cast(cast(min_award as bigint) as varchar)) as intent from s""",
)
def search_intent(c):
    return R.search_intent(c["search_requests"].withColumns({"categories": F.array("category"), "city": F.lit(None).cast("string")}))


@query("keyword_scrub")
def keyword_scrub(c):
    return R.keyword_scrub(c["documents"])


@query("canonical_url")
def canonical(c):
    return c["pages"].select("page_id", canonical_url("url").alias("url"))


@query("safe_url_filter")
def safe_url_filter(c):
    return c["pages"].where(is_safe("url")).select("page_id", "url")


@query("page_parse")
def parsed(c):
    return page_parse(c["pages"]).select("page_id", "title", F.length("text").alias("chars"), F.size("links").alias("links"))


# ---- evidence ------------------------------------------------------------------

RESOLVED = """y as (select *, try_cast(substr(cycle, 1, 4) as int) as yr from facts), v as (select *, cycle is null or coalesce(yr >= 2024, false) as viable from y),
 m as (select *, max(case when viable then yr end) over (partition by opportunity_id, field) as newest from v), u as (select *, viable and (newest is null or yr is not distinct from newest) as usable from m),
 g as (select opportunity_id, field, coalesce(bool_or(usable and conflict), false) as clash, min(case when usable then value end) as lo, max(case when usable then value end) as hi from u group by 1, 2),
 p as (select opportunity_id, field, case when not clash and lo = hi then lo end as value, case when clash then 'conflicting timeline' when lo is null then 'only historical evidence' when lo <> hi then 'conflicting evidence' end as reason from g),
 q as (select *, max(case when field = 'rolling' then value end) over (partition by opportunity_id) as rolling, max(case when field = 'deadline' then value end) over (partition by opportunity_id) as due from p),
 c as (select *, coalesce(rolling = 'true' and due is not null, false) as twice from q),
 resolved as (select opportunity_id, field, case when (twice and field in ('rolling', 'deadline')) or (not twice and field = 'status' and coalesce(value = 'open' and due < '2024-01-31', false)) then null else value end as value,
  case when twice and field in ('rolling', 'deadline') then 'rolling and fixed deadline' when not twice and field = 'status' and coalesce(value = 'open' and due < '2024-01-31', false) then 'open but elapsed' else reason end as reason from c)"""


@query("resolve_facts", f"with {RESOLVED} select * from resolved")
def resolve_facts(c):
    return R.resolve_facts(c["facts"])


@query(
    "apply_facts",
    f"""with {RESOLVED}, cur as (select id as opportunity_id, unnest(['status', 'recurrence', 'deadline', 'rolling', 'maximum']) as field, unnest([application_status, recurrence, cast(deadline as string), cast(rolling as string), cast(cast(floor(maximum_award) as bigint) as string)]) as cur from opportunities)
 select r.opportunity_id, r.field, cur.cur as current, r.value, case when r.value is null and contains(r.reason, 'only historical') then 'not_checked' when r.value is null then 'conflicting' when r.value is not distinct from cur.cur then 'unchanged' else 'found' end as state from resolved r join cur on cur.opportunity_id = r.opportunity_id and cur.field = r.field""",
)
def apply_facts(c):
    return R.apply_facts(R.resolve_facts(c["facts"]), c["opportunities"])


@query("missing_fields", f"select id, field from (select id, unnest([case when deadline is null and not rolling then 'deadline' end, case when maximum_award is null then 'maximum' end, case when application_status = 'unknown' then 'status' end, case when eligibility_notes in ('', 'Unknown') then 'eligibility' end]) as field from opportunities o where {VISIBLE}) where field is not null")
def missing_fields(c):
    return R.missing_fields(c["opportunities"])


# ---- batch twins of the streams ------------------------------------------------


@query("hourly_runs", "select date_trunc('hour', ts) as run, count(*) as events from crawl_visits group by 1")
def hourly_runs(c):
    return M.hourly_runs(c["crawl_visits"])


@query("visit_dedup", "select run, source_id, opportunity_id, arg_min(id, (ts, id)) as id from crawl_visits group by 1, 2, 3")
def visit_dedup(c):
    return M.visit_dedup(c["crawl_visits"])


@query("trailing_activity", "select id, opportunity_id, count(*) over (partition by opportunity_id order by epoch(date_trunc('second', ts)) range between 86400 preceding and current row) as last_1d, count(*) over (partition by opportunity_id order by epoch(date_trunc('second', ts)) range between 604800 preceding and current row) as last_7d, count(*) over (partition by opportunity_id order by epoch(date_trunc('second', ts)) range between 2592000 preceding and current row) as last_30d from crawl_visits")
def trailing_activity(c):
    return M.trailing_activity(c["crawl_visits"])


@query(
    "monitor_fold",
    """with v as (select * from (select *, row_number() over (partition by opportunity_id, run order by ts, id) as n from crawl_visits) where n = 1),
 p as (select opportunity_id, arg_max(outcome, (ts, id)) filter (where outcome in ('discontinued', 'reopened')) as s, max(ts) filter (where outcome <> 'failed') as last_success, arg_max(id, (ts, id)) filter (where outcome <> 'failed') as ok_id, count(*) as checks from v group by 1)
 select p.opportunity_id, case when p.s = 'discontinued' then 'discontinued' else 'active' end as state, (select count(*) from v where v.opportunity_id = p.opportunity_id and v.outcome = 'failed' and (p.last_success is null or (v.ts, v.id) > (p.last_success, p.ok_id))) as failures, p.last_success, p.checks from p""",
)
def monitor_fold(c):
    return M.monitor_fold(c["crawl_visits"])


@query("rate_limit")
def rate_limit(c):
    return M.rate_limit(c["request_attempts"])


#: One of the labels that the flagship query filters by.
FLAGSHIP_CATEGORY = CATEGORIES[0]


@query("flagship", f"with {WIDE} select id, name, funder, status, current_deadline, maximum_award from wide where status = 'open' and maximum_award >= 905 and list_contains(categories, '{FLAGSHIP_CATEGORY}') order by current_deadline asc nulls last, name, id", texts=('current_deadline',))
def flagship(c):
    """Open programs of a category with an award of 905 or more, by deadline."""
    rows = C.facet_filter(C.catalog_wide(c), (FLAGSHIP_CATEGORY,), status="open", min_award=905)
    return rows.orderBy(F.asc_nulls_last("current_deadline"), "name", "id").select("id", "name", "funder", "status", "current_deadline", "maximum_award")


publication.register_targets()
