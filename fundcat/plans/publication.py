"""Registered queries of the publication operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.functions import roles as P
from fundcat.operators import catalog as C
from fundcat.operators import evidence as E
from fundcat.operators import publication as U
from fundcat.plans.base import HOST, KEY, NOW, query

CLOSED = "publication_state = 'hidden' or verification_status = 'archived' or merged_into is not null"


@query(
    "link_register",
    f"""with f as (select l.*, {HOST.format('link')} as host, s.domain from found_links l join crawl_sources s on s.id = l.source_id), i as (select source_id, link as url, min(depth) as depth, 1 as new from f where host = domain and depth <= 3 group by 1, 2),
 b as (select source_id, url, min(depth) as depth, min(new) as new from (select source_id, url, depth, 0 as new from crawl_frontier union all select * from i) group by 1, 2), r as (select *, row_number() over (partition by source_id order by new, depth, url) as place from b)
 select source_id, url, depth from r where place <= 60 or new = 0 union all select source_id, 'domain ' || host, min(length(link)) * 0 - 1 from f where host <> domain group by 1, host""",
)
def link_register(c):
    kept, foreign = U.link_register(c["found_links"], c["crawl_sources"], c["crawl_frontier"], most=60)
    return kept.unionByName(foreign.select("source_id", F.concat(F.lit("domain "), "domain").alias("url"), F.lit(-1).alias("depth")))


@query("publish_queue", "select c.id, c.created_at, coalesce(r.attempts, 0) as attempts from crawl_candidates c left join publication_runs r on r.candidate_id = c.id where c.status = 'pending' and c.kind <> 'domain' and (r.candidate_id is null or r.parser_version <> 'v14' or r.processed_at < c.created_at or (r.outcome = 'failed' and r.attempts < 3))")
def publish_queue(c):
    return U.publish_queue(c["crawl_candidates"], c["publication_runs"], "v14")


_HP = "regexp_extract({0}, '^https?://([^/?#]+)', 1) || '|' || regexp_replace(regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1), '/$', '')"
DECIDED = f"""nw as (select url, arg_max(content_hash, (fetched_at, id)) as newest from publish_snapshots group by 1), al as (select url, min(opportunity_id) as a from opportunity_source_urls group by 1), live as (select *, {KEY} as key, {_HP.format('source_url')} as hp from opportunities where not is_demo),
 bu as (select source_url as url, min(id) as b from live group by 1), kk as (select key, count(*) as same, min(id) as same_id from live group by 1), pp as (select hp, count(*) as above, min(id) as above_id from live group by 1),
 c0 as (select c.id, c.url, c.title, c.status, c.kind, c.content_hash, c.opportunity_id, s.body, src.domain, nw.newest, a, b, {P.role_sql('c.title', 'c.url', 's.body')} as role from publish_candidates c left join publish_snapshots s on s.id = c.snapshot_id left join crawl_sources src on src.id = c.source_id left join nw on nw.url = c.url left join al on al.url = c.url left join bu on bu.url = c.url),
 tie as (select c.id, o.id as program, o.merged_into is null as own from c0 c join live o on regexp_replace(o.source_url, '/+$', '') = regexp_replace(c.url, '/+$', '') or (c.role in ('application', 'guidelines', 'faq', 'supporting') and starts_with({_HP.format('c.url')}, regexp_replace(o.hp, '/+$', '') || '/'))), pv as (select id, count(distinct program) as ways, min(program) as by_page from tie where own group by 1),
 c1 as (select c0.*, {P.classify_sql('title', 'url', 'body', 'role')} as reason, {KEY.replace('name', 'title')} as key, case when regexp_matches(url, '/(apply-now|application)/?$') then regexp_replace({_HP.format('url')}, '/(apply-now|application)/?$', '') end as hp from c0),
 c2 as (select c1.*, coalesce(a, c1.opportunity_id, b, case when ways = 1 then by_page end) as grant_id from c1 left join pv on pv.id = c1.id),
 c3 as (select c2.*, same, same_id, above, above_id, o.id is not null as known, {CLOSED.replace('publication_state', 'o.publication_state').replace('verification_status', 'o.verification_status').replace('merged_into', 'o.merged_into')} as closed, o.source_url as grant_url, c2.status = 'pending' and c2.kind <> 'domain' as pending, coalesce(body is not null and {HOST.format('c2.url')} = c2.domain, false) as approved, coalesce(newest = content_hash, false) as fresh,
  exists (select 1 from tie t where t.id = c2.id and t.program = c2.grant_id) or exists (select 1 from evidence_pages e where e.opportunity_id = c2.grant_id and e.url = c2.url) as held from c2 left join kk on kk.key = c2.key left join pp on pp.hp = c2.hp left join opportunities o on o.id = c2.grant_id),
 c4 as (select *, pending and approved and fresh and not known and reason is null and same is null and above is null as open_, held or (regexp_replace(url, '/+$', '') = regexp_replace(grant_url, '/+$', '') and reason is null) as tied from c3), c5 as (select *, open_ and row_number() over (partition by key, open_ order by id) = 1 as first from c4)"""


@query(
    "publish_decide",
    f"""with {DECIDED} select id, case when pending and approved and fresh and known and not closed and coalesce(tied, false) then 'updated' when pending and approved and fresh and not known and reason is null and first then 'published' else 'skipped' end as outcome,
 case when not pending then 'Not a pending grant candidate' when not coalesce(approved, false) then 'Source evidence or approved domain is missing' when not fresh then 'A newer source snapshot requires review' when not known and reason is not null then reason when known and closed then 'Editor-hidden or merged listing stays unpublished'
  when known and not coalesce(tied, false) then 'Program association unresolved; enrichment scheduled' when known then 'Official evidence processed with field history and locks' when not first then 'Likely duplicate program — merge or review the existing listing' else 'Published unverified grant lead' end as reason,
 case when pending and approved and fresh then case when known then grant_id when reason is null and coalesce(same, 0) + coalesce(above, 0) = 1 then coalesce(same_id, above_id) when reason is null and same = 1 and above = 1 and same_id = above_id then same_id end end as opportunity_id,
 pending and approved and fresh and not known and reason is not null and role not in ('program', 'ambiguous') as dismissed from c5""",
)
def publish_decide(c):
    pages = c["publish_candidates"].select("id", "url", "title", "snapshot_id").join(c["publish_snapshots"].select(F.col("id").alias("snapshot_id"), "body"), "snapshot_id")
    tied = E.related_pages(pages, c["opportunities"].where("not is_demo"), c["page_links"])
    return U.publish_decide(c["publish_candidates"], c["publish_snapshots"], c["crawl_sources"], c["opportunities"], c["opportunity_source_urls"], tied, c["evidence_pages"])


@query(
    "feed_import",
    f"""with u as (select url, min(opportunity_id) as by_url from (select url, opportunity_id from opportunity_source_urls union all select source_url, id from opportunities) group by 1), t as (select distinct lower(o.name) as lt, lower(f.name) as lf from opportunities o join funders f on f.id = o.funder_id where merged_into is null),
 e as (select r.*, md5(title || '|' || coalesce(funder, '') || '|' || r.url || '|' || content) as hash, k.hash as prior, coalesce(k.opportunity_id, u.by_url) as opportunity_id from feed_records r left join feed_known k on k.provider = r.provider and k.external_id = r.external_id left join u on u.url = r.url)
 select provider, external_id, e.url, hash, e.opportunity_id, case when {CLOSED} then 'skipped' when e.opportunity_id is null and t.lt is not null then 'skipped' when prior = hash then 'unchanged' when o.id is not null then 'updated' else 'published' end as outcome from e left join opportunities o on o.id = e.opportunity_id left join t on t.lt = lower(e.title) and t.lf = lower(e.funder)""",
)
def feed_import(c):
    return U.feed_import(c["feed_records"], c["feed_known"], c["opportunities"], c["opportunity_source_urls"], c["funders"])


FAMILY = "family as (with recursive r(id, family, hops) as (select id, id, 0 from opportunities where merged_into is null union all select o.id, r.family, r.hops + 1 from opportunities o join r on o.merged_into = r.id where r.hops < 20) select id, family from r)"


@query(
    "merge_apply",
    f"""with {FAMILY}, s as (select workspace_id, coalesce(f.family, opportunity_id) as opportunity_id, min((coalesce(f.family, opportunity_id) <> opportunity_id, saved_at)) as m from saved_opportunities s left join family f on f.id = s.opportunity_id group by 1, 2)
 select 'saved' as tab, workspace_id || ' ' || opportunity_id as k, cast(m[2] as varchar) as v from s union all select 'application', a.id, coalesce(f.family, a.opportunity_id) from applications a left join family f on f.id = a.opportunity_id union all select 'url', url, min(coalesce(f.family, opportunity_id)) from opportunity_source_urls u left join family f on f.id = u.opportunity_id group by url""",
)
def merge_apply(c):
    tables = {"saved": c["saved_opportunities"], "applications": c["applications"], "urls": c["opportunity_source_urls"]}
    out = U.merge_apply(C.merge_families(c["opportunities"]), tables, {"saved": ["workspace_id", "opportunity_id"]})
    urls = out["urls"].groupBy("url").agg(F.min("opportunity_id").alias("v"))
    rows = out["saved"].select(F.lit("saved").alias("tab"), F.concat_ws(" ", "workspace_id", "opportunity_id").alias("k"), F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("v"))
    return rows.union(out["applications"].select(F.lit("application"), "id", "opportunity_id")).union(urls.select(F.lit("url"), "url", "v"))


@query("save_applications", """with w as (select distinct workspace_id, s.opportunity_id, regexp_replace(o.source_url, '/+$', '') as url from saved_opportunities s join opportunities o on o.id = s.opportunity_id), i as (select workspace_id, opportunity_id, arg_min(id, (created_at, id)) as by_id from applications where opportunity_id is not null group by 1, 2),
 u as (select workspace_id, regexp_replace(source_url, '/+$', '') as url, arg_min(id, (created_at, id)) as by_url from applications group by 1, 2) select w.workspace_id, w.opportunity_id, coalesce(by_id, by_url, 's-' || w.workspace_id || '-' || w.opportunity_id) as application_id, case when by_id is not null then 'kept' when by_url is not null then 'linked' else 'added' end as action
 from w left join i on i.workspace_id = w.workspace_id and i.opportunity_id = w.opportunity_id left join u on u.workspace_id = w.workspace_id and u.url = w.url""")
def save_applications(c):
    return U.save_applications(c["saved_opportunities"], c["applications"], c["opportunities"])


@query("contribution_upsert", "with n as (select url, opportunity_id, field, count(distinct user_id) as submissions from suggestions group by 1, 2, 3) select n.*, cast(o.id as string) as id, o.id is null as is_new from n left join suggestions_old o on o.url = n.url and o.opportunity_id is not distinct from n.opportunity_id and o.field = n.field")
def contribution_upsert(c):
    return U.contribution_upsert(c["suggestions"], c["suggestions_old"]).withColumn("id", F.col("id").cast("string"))


@query(
    "contribution_settle",
    f"""with shown as (select * from opportunities where publication_state = 'published' and merged_into is null), urls as (select source_url as url from shown union select a.url from opportunity_source_urls a join shown o on o.id = a.opportunity_id), ok as (select distinct domain from crawl_sources where enabled),
 r as (select s.*, u.url is not null as listed, ok.domain is not null as approved, f.state as fs, f.evidence_url from suggestions_old s left join urls u on u.url = s.url left join ok on ok.domain = {HOST.format('s.url')} left join field_evidence f on f.opportunity_id = s.opportunity_id and f.field = s.field where s.state <> 'applied'),
 v as (select id, case when opportunity_id is null and listed then 1 when not approved then 2 when opportunity_id is not null and fs = 'found' and evidence_url = url then 3 when opportunity_id is not null and fs in ('conflicting', 'locked_conflict') then 4 else 5 end as n from r)
 select id, ['applied', 'decision', 'applied', 'decision', 'unconfirmed'][n] as state, ['This source is linked to a published catalog program.', 'Official source approval required before checking this URL.', 'Official evidence checked.', 'Conflicting official evidence or a locked correction needs review.', 'The page did not establish the requested fact.'][n] as reason from v""",
)
def contribution_settle(c):
    return U.contribution_settle(c["suggestions_old"], c["opportunities"], c["opportunity_source_urls"], c["crawl_sources"], c["field_evidence"])


@query("lead_upsert", "with b as (select workspace_id, url, title, seen_at, run_id as run from lead_reports union all select workspace_id, url, title, seen_at, -1 from lead_store), n as (select workspace_id, url, max((seen_at, run, title)) as l from b group by 1, 2), p as (select source_url as url, min(id) as program from opportunities group by 1) select workspace_id, n.url, l[3] as title, l[2] as run, program from n left join p on p.url = n.url")
def lead_upsert(c):
    return U.lead_upsert(c["lead_reports"], c["lead_store"], c["opportunities"])


@query("run_status", "select run_id, count(url) as leads, case when sum(warnings) = 0 then 'complete' when count(url) > 0 then 'partial' else 'failed' end as status from lead_reports group by 1")
def run_status(c):
    return U.run_status(c["lead_reports"])


def _asked(c):
    return c["target_jobs"].withColumns({"categories": F.array("category"), "focus": F.array("focus_tag"), "city": F.lit(None).cast("string")})


def _jobs(c, jobs):
    wide = C.catalog_wide(c)
    cards = U.target_cards(wide, c["program_origins"], c["catalog_monitoring"], C.latest_snapshot(c["crawl_snapshots"]))
    return U.target_match(jobs, cards, c["opportunity_geographies"]), wide, jobs


def _wide() -> str:
    from fundcat.plans.registry import WIDE

    return WIDE


def matched_sql() -> str:
    body, home = "coalesce(sn.body, w.summary)", "regexp_extract(w.source_url, '^https?://[^/?#]+') || '/program'"
    return f"""{_wide()}, sn as (select url, arg_max(body, (fetched_at, id)) as body from crawl_snapshots where fetched_at <= {NOW} group by 1),
 cd as (select w.*, lower(w.name || ' ' || coalesce(w.funder, '') || ' ' || w.summary || ' ' || w.eligibility_notes || ' ' || array_to_string(w.categories, ' ')) as said, len(w.categories) > 0 and not (publication_origin = 'crawler' and coalesce(category_origin, '') not in ('editor', 'official')) as known, greatest(m.last_success_at, g.source_fetched_at, w.last_checked_at, g.last_verified_at) as checked
  from wide w left join program_origins g on g.id = w.id left join catalog_monitoring m on m.opportunity_id = w.id left join sn on sn.url = w.source_url where coalesce(m.state, 'active') <> 'discontinued' and ({P.role_sql('w.name', 'w.source_url', body)} = 'program' or {P.role_sql('w.name', home, body)} = 'program')),
 rl as (select j.country, j.state, g.opportunity_id, g.rule, coalesce(g.country, g.state, g.city) is not null as named, case when (gc <> '' and gc <> j.country) or (g.state is not null and j.state is not null and g.state <> j.state) then 'different' when (g.state is not null and j.state is null) or g.city is not null then 'unknown' else 'matches' end as rel
  from (select *, case when country is null or country = 'Worldwide' then '' else country end as gc from opportunity_geographies) g cross join (select distinct country, state from target_jobs where country is not null) j),
 ge as (select country, state, opportunity_id, case when bool_or(rule = 'excluded' and rel = 'matches') then 'excluded' when bool_or(rule = 'eligible' and named and rel = 'matches') and not bool_or(rule = 'excluded' and rel = 'unknown') then 'eligible' when bool_or(rule = 'eligible' and named) and not bool_or(rule = 'eligible' and named and rel <> 'different') then 'excluded' else 'unknown' end as geo from rl group by 1, 2, 3),
 tm as (select j.job_id, j.status as wanted, w.id, w.status, w.created_at, w.source_url, list_contains(w.applicants, j.applicant) as fits, geo, (j.min_award = 0 or coalesce(w.maximum_award >= j.min_award, false)) as enough, coalesce(w.checked >= {NOW} - interval 1 day, false) as recent, j.category is null or (known and list_contains(w.categories, j.category)) as sure
  from target_jobs j join cd w on (j.category is null or not known or list_contains(w.categories, j.category)) and len(list_filter(string_split(j.q, ' '), lambda t: not contains(w.said, t))) = 0 join ge on ge.country = j.country and ge.state is not distinct from j.state and ge.opportunity_id = w.id
  where j.applicant is not null and (j.freshness = '' or (j.freshness = 'new' and w.created_at >= {NOW} - interval 7 day) or (j.freshness = 'updated' and w.catalog_updated_at >= {NOW} - interval 7 day)) and (list_contains(w.applicants, j.applicant) or len(w.applicants) = 0) and geo <> 'excluded' and (j.min_award = 0 or w.maximum_award is null or w.maximum_award >= j.min_award)
   and (j.focus_tag is null or case j.focus_tag when 'women' then regexp_matches(w.said, '\\b(?:women|woman|female|womxn)\\b') else regexp_matches(w.said, '\\b(?:rural|remote communities|small[- ]towns?)\\b') end)),
 ts as (select *, fits and geo = 'eligible' and enough and recent and sure as strict from tm)"""


def register_targets() -> None:
    """These two read the catalog's wide row, which the main registry defines."""

    @query("target_match", f"with {matched_sql()} select job_id, id, status, strict from ts")
    def target_match(c):
        return _jobs(c, _asked(c))[0]

    @query(
        "target_counts",
        f"""with {matched_sql()}, fi as (select job_id, regexp_replace(source_url, '/+$', '') as i, arg_min(status, (created_at, id)) as status, any_value(coalesce(wanted, 'open')) as wanted from ts where strict group by 1, 2), co as (select job_id, count(*) filter (where status = wanted) as matched, count(*) filter (where status in ('upcoming', 'between_rounds')) as watchlist from fi group by 1),
 td as (select job_id, string_agg(id, ',' order by place) as research from (select job_id, id, row_number() over (partition by job_id order by created_at, id) as place from ts where not strict or status = 'unknown') where place <= 10 group by 1)
 select coalesce(co.job_id, td.job_id) as job_id, coalesce(matched, 0) as matched, coalesce(watchlist, 0) as watchlist, research from co full join td on td.job_id = co.job_id""",
    )
    def target_counts(c):
        members, askers = U.same_searches(_asked(c))
        counts = U.target_counts(*_jobs(c, askers)).withColumnRenamed("job_id", "asker")
        return members.join(counts, "asker").select("job_id", *[x for x in counts.columns if x != "asker"])


@query("ledger_admit")
def ledger_admit(c):
    return U.ledger_admit(c["ledger_requests"])


@query("worker_throughput", "select s.id, count(distinct w.url) as checked, count(w.url) as pages from worker_samples s left join worker_checks w on w.at >= s.started and w.at <= s.finished group by 1")
def worker_throughput(c):
    return U.worker_throughput(c["worker_samples"], c["worker_checks"])


@query(
    "search_hits",
    """with h as (select run_id, n, unnest(json_extract(raw, '$.results[*]')) as h, generate_subscripts(json_extract(raw, '$.results[*]'), 1) as k from search_raw), u as (select run_id, n, k, json_extract_string(h, '$.url') as raw_url, json_extract_string(h, '$.title') as title from h),
 f as (select run_id, regexp_replace(regexp_replace(raw_url, '#.*$', ''), '/+$', '') as url, min((n, k, title)) as f from u where starts_with(raw_url, 'https://') group by 1, 2), p as (select *, row_number() over (partition by run_id order by f[1], f[2]) as place from f)
 select run_id, cast(place as int) as place, url, trim(regexp_replace(f[3], '<[^>]*>', '', 'g')) as title from p where place <= 30""",
)
def search_hits(c):
    return U.search_hits(c["search_raw"])


@query(
    "cited_links",
    """with m as (select id, unnest(json_extract(raw, '$.output[*]')) as m from cited_raw), a as (select id, unnest(json_extract(m, '$.content[*].annotations[*]')) as a, generate_subscripts(json_extract(m, '$.content[*].annotations[*]'), 1) as k from m where json_extract_string(m, '$.type') = 'message'),
 u as (select id, k, json_extract_string(a, '$.url') as url from a where json_extract_string(a, '$.type') = 'url_citation'), g as (select id, regexp_replace(url, '/+$', '') as url, min(k) as k from u where starts_with(url, 'https://') and not regexp_matches(url, '(?i)[?].*(token|secret|password|auth|session)') group by 1, 2)
 select id, cast(row_number() over (partition by id order by k) - 1 as int) as place, url from g""",
)
def cited_links(c):
    return U.cited_links(c["cited_raw"])


@query("feed_page_checkpoint", """select p.session_id, provider, coalesce(n, 0) as retrieved, staged, staged = 0 and cursor >= total and phase >= case provider when 'federal' then 2 else 0 end as exhausted, case when staged = 0 and cursor >= total and phase >= case provider when 'federal' then 2 else 0 end then 'received' else 'more' end as status,
 case when staged = 0 and cursor >= total and provider = 'federal' and phase < 2 then phase + 1 else phase end as next_phase, case when staged = 0 and cursor >= total and provider = 'federal' and phase < 2 then 0 else cursor end as next_cursor from feed_progress p left join (select session_id, count(*) as n from feed_session_results group by 1) r on r.session_id = p.session_id""")
def feed_page_checkpoint(c):
    return U.feed_page_checkpoint(c["feed_progress"], c["feed_session_results"], {"federal": 2, "state": 0})


@query(
    "admin_catalog",
    f"""with p as (select opportunity_id as id, string_agg(distinct url, ',' order by url) as pages from evidence_pages group by 1), s as (select opportunity_id as id, string_agg(field || '=' || state, ',' order by field, state) as states, count(*) filter (where state <> 'known') as unresolved from catalog_fields group by 1),
 h as (select opportunity_id as id, string_agg(field || '=' || coalesce(new_value, ''), ',' order by place) as changes from (select *, row_number() over (partition by opportunity_id order by created_at desc, id desc) as place from catalog_field_history) where place <= 5 group by 1)
 select o.id, pages, states, unresolved, changes, last_checked_at < {NOW} - ({{HOURS}}) * interval 1 hour as overdue from opportunities o left join p on p.id = o.id left join s on s.id = o.id left join h on h.id = o.id""".replace("{HOURS}", "case when opens between date '2024-01-31' and date '2024-01-31' + 30 then 6 when application_status = 'closed' then case when recurrence in ('annual', 'recurring') then 24 else 168 end when deadline between date '2024-01-31' and date '2024-01-31' + 30 then 6 else 24 end"),
)
def admin_catalog(c):
    rows = U.admin_catalog(c["opportunities"], c["evidence_pages"], c["catalog_fields"], c["catalog_field_history"])
    pairs = lambda col, k, v: F.array_join(F.transform(col, lambda x: F.concat_ws("=", x[k], F.coalesce(x[v], F.lit("")))), ",").alias(col)
    return rows.select("id", F.array_join("pages", ",").alias("pages"), pairs("states", "field", "state"), F.size("unresolved").cast("long").alias("unresolved"), pairs("changes", "field", "new_value"), "overdue")


SEEDS = "seeds as (select 'o' || cast(2 * p_partkey as varchar) as slug, p_name as name, case when p_partkey % 3 = 0 then 'Fund ' || cast(p_partkey % 7 as varchar) else 'Supplier#000000001' end as funder, a.name as c1, b.name as c2 from part join category_names a on a.n = p_partkey % 14 join category_names b on b.n = (p_partkey + 1) % 14), fresh as (select * from seeds where slug not in (select id from opportunities))"


@query(
    "seed_load",
    f"""with {SEEDS} select 'funder' as tab, funder as k from (select distinct funder from seeds) where funder not in (select name from funders) union all select 'program', slug || ' ' || name from fresh union all select 'category', slug || ' ' || c1 from fresh union all select 'category', slug || ' ' || c2 from fresh
 union all select 'place', slug || ' ' || country || ' ' || coalesce(state, '') from (select slug, country, state from seeds cross join (values ('United States', null), ('Canada', 'Ontario')) as v(country, state)) s where not exists (select 1 from opportunity_geographies g where g.opportunity_id = s.slug and g.country = s.country and g.state is not distinct from s.state and g.city is null)""",
)
def seed_load(c):
    names = lambda n: c["category_names"].select(F.col("n").alias(f"n{n}"), F.col("name").alias(f"c{n}"))
    k, place = F.col("p_partkey"), "struct<country:string,state:string,city:string>"
    at = lambda country, state: F.struct(F.lit(country).alias("country"), F.lit(state).cast("string").alias("state"), F.lit(None).cast("string").alias("city")).cast(place)
    seed = c["part"].join(names(1), F.col("n1") == k % 14).join(names(2), F.col("n2") == (k + 1) % 14)
    seed = seed.select(F.concat(F.lit("o"), 2 * k).alias("slug"), F.col("p_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("Fund "), k % 7)).otherwise("Supplier#000000001").alias("funder"), F.array("c1", "c2").alias("categories"), F.array(at("United States", None), at("Canada", "Ontario")).alias("places"))
    out = U.seed_load(seed, c["funders"], c["opportunities"], c["opportunity_geographies"])
    row = lambda tab, *cols: out[tab + ("ies" if tab == "categor" else "s")].select(F.lit("category" if tab == "categor" else tab).alias("tab"), F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in cols]).alias("k"))
    return row("funder", "name").union(row("program", "slug", "name")).union(row("categor", "slug", "category")).union(row("place", "slug", "country", "state"))


@query("public_export", "select id, name, summary, source_url, application_status, deadline, opens, rolling, recurrence, maximum_award, minimum_award, publication_state, merged_into, 'export' as method from opportunities where not is_demo", texts=("deadline", "opens"))
def public_export(c):
    out = U.public_export({t: c[t] for t in (*U.PUBLIC, "saved_opportunities")})["opportunities"]
    return out.withColumn("method", F.col("provenance")["method"]).drop("provenance")


_KNOWN = "['australia', 'brazil', 'canada', 'china', 'france', 'georgia', 'germany', 'india', 'ireland', 'italy', 'japan', 'kenya', 'mexico', 'netherlands', 'new zealand', 'nigeria', 'south africa', 'spain', 'sweden', 'switzerland', 'united kingdom', 'united states', 'worldwide']"


@query(
    "source_intent_rank",
    f"""with j as (select job_id, category, country, state, case when q = 'grant' then ['music', 'performing', 'artist'] else ['technology', 'innovation', 'research'] end as terms from search_intents), s as (select *, list_transform(regexp_split_to_array(scope, '\\s*[,/|]\\s*'), lambda x: lower(trim(x))) as parts from source_registry),
 n as (select *, list_transform(parts, lambda x: case x when 'usa' then 'united states' else x end) as nations from s), p as (select job_id, id, coalesce(country, '') as country, lower(coalesce(country, '')) as lc, lower(coalesce(state, '')) as ls, terms, c1, c2, category, lower(name || ' ' || url) as said, scope, parts, nations from j join n on category in (c1, c2)),
 g as (select *, cast(case when lc = '' then 1 when len(list_filter(nations, lambda x: not list_contains({_KNOWN}, x))) = 0 and (list_contains(nations, lc) or list_contains(nations, 'worldwide')) then 2 when len(parts) = 1 and list_contains(nations, lc) then 2
  when not (list_contains(nations, lc) or (lc = 'united states' and (len(list_filter(nations, lambda x: list_contains({_KNOWN}, x))) = 0 or (len(parts) = 1 and parts[1] = ls)))) then 0 when ls <> '' and len(list_filter(nations, lambda x: x <> lc)) = 1 and list_contains(parts, ls) then 3 when lc = 'united states' and lower(scope) in ('national', 'nationwide') then 2 else 0 end as int) as geo,
  cast(10 + len(list_filter(terms, lambda t: contains(said, t))) as int) as score from p), r as (select *, row_number() over (partition by job_id order by geo desc, score desc, id) as place, max(geo) over (partition by job_id) as top from g where lc = '' or geo > 0)
 select job_id as intent_id, id, geo, score, cast(place as int) as place, lc <> '' and top < 3 as gap from r where place <= 8""",
)
def source_intent_rank(c):
    terms = F.when(F.col("q") == "grant", F.array(F.lit("music"))).otherwise(F.array(F.lit("technology")))
    intents = c["search_intents"].select(F.col("job_id").alias("intent_id"), F.array("category").alias("categories"), terms.alias("terms"), "country", "state", F.lit(None).cast("string").alias("city"))
    return U.source_intent_rank(intents, c["source_registry"].select("id", "name", "url", F.array("c1", "c2").alias("categories"), "scope"))
