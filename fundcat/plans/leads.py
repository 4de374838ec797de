"""Registered queries of leads, sources, feeds, reviews and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.operators import catalog as C
from fundcat.operators import leads as L
from fundcat.plans.base import HOST, NOW, TODAY, VISIBLE, query
from fundcat.sources import feeds

LIVE = "publication_state = 'published' and merged_into is null"
PENDING = "c.status = 'pending' and c.kind <> 'domain'"
UNALIASED = f"""{PENDING} and not exists (select 1 from opportunities o where o.id = c.opportunity_id and (publication_state = 'hidden' or verification_status = 'archived' or merged_into is not null))
 and not exists (select 1 from opportunity_source_urls a join opportunities o on o.id = a.opportunity_id where a.url = c.url and {LIVE})
 and not exists (select 1 from opportunities o where o.source_url = c.url and {LIVE})
 and not exists (select 1 from catalog_monitoring m join opportunities o on o.id = m.opportunity_id where m.state = 'discontinued' and (o.id = c.opportunity_id or o.source_url = c.url))"""


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern}', 'i')"


LEAD = f"""{has('c.title', L.TITLE_WORDS)} and not {has('c.title', L.NOT_TITLES)} and not {has('c.url', L.NOT_URLS)} and not {has('c.title', L.DIRECTORY_TITLES)}
 and exists (select 1 from crawl_snapshots s where s.id = c.snapshot_id and {has('s.body', L.BODY_WORDS)})
 and not exists (select 1 from publication_results r where r.candidate_id = c.id and r.outcome = 'skipped' and {has('r.reason', L.SKIPPED)})"""


def source_sql(urls: str) -> str:
    return f"""select u.url, (select s.id from crawl_sources s where s.domain = {HOST.format('u.url')} order by s.url = u.url desc, s.enabled desc, s.id limit 1) as source_id from {urls} u"""


# ---- feeds ---------------------------------------------------------------------


def day(c: str) -> str:
    iso = f"regexp_extract({c}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)"
    us = f"regexp_replace(regexp_extract({c}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}'), '^(\\d{{2}})/(\\d{{2}})/(\\d{{4}})$', '\\3-\\1-\\2')"
    return f"coalesce(try_cast({iso} as date), try_cast({us} as date))"


def money(c: str) -> str:
    return f"case when regexp_matches(replace(replace({c}, '$', ''), ',', ''), '^\\d+(\\.\\d{{1,2}})?$') then cast(replace(replace({c}, '$', ''), ',', '') as double) end"


def kinds(codes: str, values: dict[str, str]) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in values.items())
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({codes}, lambda x: case trim(x) {arms} end), lambda x: x is not null))), ',')"


def dated(status: str) -> str:
    return f"case when {status} = 'open' and posted > {TODAY} then 'upcoming' when {status} = 'open' and deadline < {TODAY} then 'closed' else {status} end"


@query(
    "feed_federal",
    f"""with r as (select raw ->> '$.id' as id, trim(raw ->> '$.opportunityTitle') as title, raw ->> '$.synopsis.agencyName' as funder, lower(raw ->> '$.ost') as was, {day("(raw ->> '$.synopsis.responseDateStr')")} as deadline, {day("(raw ->> '$.synopsis.postingDateStr')")} as posted,
 {money("(raw ->> '$.synopsis.awardFloor')")} as minimum, {money("(raw ->> '$.synopsis.awardCeiling')")} as maximum, {kinds("json_extract_string(raw, '$.synopsis.applicantTypes[*].id')", feeds.FEDERAL_APPLICANTS)} as applicants from feed_federal_raw where list_contains(json_extract_string(raw, '$.synopsis.fundingInstruments[*].id'), 'G')),
 s as (select *, case was when 'posted' then 'open' when 'forecasted' then 'upcoming' when 'closed' then 'closed' when 'archived' then 'closed' end as st from r)
 select id, title, funder, {dated('st')} as status, deadline, case when was <> 'forecasted' then posted end as opens, minimum, maximum, applicants from s where length(title) between 8 and 250""",
    texts=("deadline", "opens"),
)
def feed_federal(c):
    return feeds.feed_federal(c["feed_federal_raw"])


@query(
    "feed_state",
    f"""with r as (select raw ->> '$.PortalID' as id, trim(raw ->> '$.Title') as title, raw ->> '$.AgencyDept' as funder, lower(raw ->> '$.Status') as was, {day("(raw ->> '$.ApplicationDeadline')")} as deadline, cast(null as date) as posted, raw ->> '$.ApplicationDeadline' as due, raw ->> '$.EstAmounts' as amounts,
 {kinds("string_split(raw ->> '$.ApplicantType', ';')", feeds.STATE_APPLICANTS)} as applicants, raw ->> '$.Geography' as geo from feed_state_raw where lower(trim(raw ->> '$.Type')) = 'grant'),
 s as (select *, case was when 'active' then 'open' when 'closed' then 'closed' end as st, regexp_extract(amounts, '^Between (\\$[\\d,.]+) and', 1) as a, regexp_extract(amounts, ' and (\\$[\\d,.]+)$', 1) as b from r),
 m as (select *, {money('a')} as lo, {money('b')} as hi, {money("(case when amounts like '$%' then amounts end)")} as one from s)
 select id, title, funder, {dated('st')} as status, deadline, regexp_matches(trim(due), '^(ongoing|rolling)$', 'i') as rolling, coalesce(case when lo <= hi then lo end, one) as minimum, coalesce(case when lo <= hi then hi end, one) as maximum, applicants,
 case when {has('trim(geo)', feeds.STATEWIDE.removeprefix('(?i)'))} then 'California' end as state from m where length(title) between 8 and 250""",
    texts=("deadline",),
)
def feed_state(c):
    return feeds.feed_state(c["feed_state_raw"])


@query(
    "award_examples",
    """with a as (select n, generate_subscripts(json_extract_string(raw, '$.results[*].appl_id'), 1) as place, unnest(json_extract_string(raw, '$.results[*].appl_id')) as appl_id, unnest(json_extract_string(raw, '$.results[*].opportunity_number')) as number, unnest(json_extract_string(raw, '$.results[*].project_title')) as title, unnest(json_extract_string(raw, '$.results[*].fiscal_year')) as year from award_raw),
 t as (select *, row_number() over (partition by number order by n, place) as turn from a)
 select o.id as opportunity_id, cast(turn as int) as turn, cast(appl_id as bigint) as appl_id, t.title, cast(year as int) as year from opportunities o join t on t.number = 'PAR-' || cast(o.k % 60 as string) where turn <= 10""",
)
def award_examples(c):
    programs = c["opportunities"].select(F.col("id").alias("opportunity_id"), F.concat(F.lit("PAR-"), (F.col("k") % 60).cast("string")).alias("identifier"))
    return feeds.award_examples(c["award_raw"], programs)


# ---- leads and sources -----------------------------------------------------------


@query("lead_filter", f"select c.id, c.url from crawl_candidates c where {LEAD}")
def lead_filter(c):
    return L.lead_filter(c["crawl_candidates"], c["crawl_snapshots"], c["publication_results"]).select("id", "url")


@query("unaliased_leads", f"select c.id, c.url, c.title from crawl_candidates c where {UNALIASED}")
def unaliased_leads(c):
    return L.unaliased_leads(c["crawl_candidates"], c["opportunities"], c["opportunity_source_urls"], c["catalog_monitoring"]).select("id", "url", "title")


@query("lead_dedupe", "select url, id, fetched_at from (select c.url, c.id, s.fetched_at, row_number() over (partition by c.url order by s.fetched_at desc, c.id) as place from crawl_candidates c join crawl_snapshots s on s.id = c.snapshot_id) where place = 1")
def lead_dedupe(c):
    return L.lead_dedupe(c["crawl_candidates"], c["crawl_snapshots"]).select("url", "id", "fetched_at")


@query("candidate_supersede", "select id, url, case when kind <> 'domain' and status = 'pending' and content_hash <> first_value(content_hash) over (partition by url, kind = 'domain' order by created_at desc, id desc) then 'superseded' else status end as status from crawl_candidates")
def candidate_supersede(c):
    return L.candidate_supersede(c["crawl_candidates"]).select("id", "url", "status")


@query("source_for_url", source_sql("(select source_url as url from opportunities union select url from crawl_sources)"))
def source_for_url(c):
    urls = c["opportunities"].select(F.col("source_url").alias("url")).union(c["crawl_sources"].select("url"))
    return L.source_for_url(urls, c["crawl_sources"])


@query("monitor_seed", f"select h.domain, programs, first_id, case when s.domain is null then 'register' when s.enabled then 'check' else 'none' end as action from (select {HOST.format('source_url')} as domain, count(*) as programs, min(id) as first_id from opportunities o where {VISIBLE} group by 1) h left join (select domain, bool_or(enabled) as enabled from crawl_sources group by 1) s on s.domain = h.domain")
def monitor_seed(c):
    return L.monitor_seed(c["opportunities"], c["crawl_sources"])


@query(
    "reconcile_inventory",
    f"""with every as (select source_url as url, 'program' as kind, id from opportunities o where {VISIBLE} union all select url, 'candidate', cast(id as string) from crawl_candidates c where {PENDING}),
 first as (select url, kind, id from (select *, row_number() over (partition by url order by kind desc, id) as n from every) where n = 1)
 select f.url, f.kind, f.id, s.source_id from first f left join ({source_sql('(select distinct url from first)')}) s on s.url = f.url""",
)
def reconcile_inventory(c):
    return L.reconcile_inventory(c["opportunities"], c["crawl_candidates"], c["crawl_sources"])


@query(
    "external_unpublished",
    "select id, provider, external_id, source_url from external_results e where not exists (select 1 from opportunities o where rtrim(o.source_url, '/') = rtrim(e.source_url, '/')) and not exists (select 1 from opportunity_source_urls a where rtrim(a.url, '/') = rtrim(e.source_url, '/')) and not exists (select 1 from provider_records p where p.provider = e.provider and p.external_id = e.external_id)",
)
def external_unpublished(c):
    return L.external_unpublished(c["external_results"], c["opportunities"], c["opportunity_source_urls"], c["provider_records"]).select("id", "provider", "external_id", "source_url")


# ---- links -------------------------------------------------------------------------


@query("linked_page_join", "select link, min(o.id) as opportunity_id from page_links l join opportunities o on o.source_url = l.url group by 1 having count(distinct o.id) = 1")
def linked_page_join(c):
    return L.linked_page_join(c["page_links"], c["opportunities"].select(F.col("id").alias("opportunity_id"), F.col("source_url").alias("url")))


@query("supporting_links", f"with f as (select url, link, min((id, n)) as spot from page_links where link <> url and {has('link', L.SUPPORTING)} group by 1, 2), p as (select url, link, row_number() over (partition by url order by contains(lower(link), '.pdf'), spot) as place from f) select url, link, cast(place as int) as place from p where place <= 30")
def supporting_links(c):
    return L.supporting_links(c["page_links"])


PATH = "lower(regexp_extract(link, '^https?://[^/]+(/[^?#]*)', 1))"


@query("page_priority", f"select distinct link, 10 * (case when contains({PATH}, 'programs') then 1 else 0 end + case when contains({PATH}, 'apply') then 1 else 0 end) + case when regexp_matches({PATH}, 'grant|fellowship|fund|award') then 4 else 0 end + case when regexp_matches({PATH}, 'apply|application|guideline|eligib|deadline|\\.pdf$') then 3 else 0 end - case when regexp_matches({PATH}, 'news|blog|recipient|winner') then 8 else 0 end as score from page_links")
def page_priority(c):
    links = c["page_links"].select("link").distinct().withColumnRenamed("link", "url")
    return L.page_priority(links, ("programs", "apply")).select(F.col("url").alias("link"), "score")


@query(
    "research_link_rank",
    """with p as (select id, source_url, list_filter(regexp_split_to_array(lower(name), '\\W+'), lambda w: length(w) > 3 and w not in ('grant', 'grants', 'program', 'funding', 'foundation')) as words,
  list_concat(list_concat(case when deadline is null then ['application', 'apply', 'deadline', 'dates'] else [] end, case when maximum_award is null then ['amount', 'guidelines', 'funding'] else [] end), ['pdf']) as terms from opportunities),
 s as (select distinct p.id, l.link, cast(len(list_filter(p.words, lambda w: contains(lower(l.link), w))) * 4 + len(list_filter(p.terms, lambda w: contains(lower(l.link), w))) * 2 as int) as score from p join page_links l on l.url = p.source_url)
 select id, link, score, cast(row_number() over (partition by id order by score desc, link) as int) as place from s where score > 0""",
)
def research_link_rank(c):
    o = c["opportunities"]
    missing = F.array_compact(F.array(F.when(F.col("deadline").isNull(), "deadline"), F.when(F.col("maximum_award").isNull(), "maximum")))
    links = c["page_links"].join(o.select(F.col("source_url").alias("url"), F.col("id").alias("program")), "url").select(F.col("program").alias("id"), "link")
    return L.research_link_rank(o.select("id", "name", missing.alias("missing")), links)


@query(
    "robots_filter",
    f"""with u as (select distinct link as url, {HOST.format('link')} as host, regexp_extract(link, '^https?://[^/]+(/[^#]*)', 1) as path from page_links),
 named as (select distinct host from robots_rules where agent = 'fundbot'), r as (select * from robots_rules where (agent = 'fundbot') = (host in (select host from named))),
 hit as (select u.url, r.allow, row_number() over (partition by u.url order by length(replace(r.pattern, '*', '')) desc, r.allow desc) as place from u join r on r.host = u.host and regexp_matches(u.path, '^' || replace(replace(r.pattern, '.', '\\.'), '*', '.*')))
 select u.url, coalesce(h.allow, true) as allowed from u left join hit h on h.url = u.url and h.place = 1""",
)
def robots_filter(c):
    return L.robots_filter(c["page_links"].select(F.col("link").alias("url")), c["robots_rules"])


CLEAN = "substr(regexp_replace(trim(coalesce({0}, '')), '\\s+', ' ', 'g'), 1, 100)"


@query(
    "normalize_location",
    f"""with r as (select id, {CLEAN.format('country')} as c, {CLEAN.format('state')} as s, {CLEAN.format('city')} as t, {CLEAN.format('postal_code')} as p from raw_locations),
 n as (select *, case when regexp_matches(c, '^(us|usa|u\\.s\\.|united states( of america)?)$', 'i') then 'United States' when regexp_matches(c, '^(uk|gb|great britain|united kingdom)$', 'i') then 'United Kingdom' when regexp_matches(c, '^(worldwide|global|international)$', 'i') then 'Worldwide' else c end as country from r),
 k as (select *, country in ('', 'United States') as us from n)
 select id, country, case when us and upper(s) in ('NY', 'NEW YORK') then 'New York' when us and upper(s) in ('CA', 'CALIFORNIA') then 'California' when us and upper(s) in ('TX', 'TEXAS') then 'Texas' else s end as state, case when us and lower(t) in ('nyc', 'new york', 'new york city') then 'New York City' else t end as city,
 case when us then case when regexp_matches(p, '^\\d{{5}}(-\\d{{4}})?$') then substr(p, 1, 5) else '' end when regexp_matches(p, '^[\\p{{L}}\\d][\\p{{L}}\\d -]{{0,19}}$') then replace(upper(p), ' ', '') else '' end as postal_code from k""",
)
def normalize_location(c):
    return L.normalize_location(c["raw_locations"])


# ---- reviews and suggestions ---------------------------------------------------------


@query(
    "review_validate",
    f"""select id, array_to_string(list_filter([case when not length(trim(name)) between 3 and 250 then 'name' end, case when not length(trim(summary)) between 20 and 3000 then 'summary' end, case when not regexp_matches(currency, '^[A-Z]{{3}}$') then 'currency' end,
 case when not minimum between 0 and 100000000 or not maximum between 0 and 100000000 then 'amount' end, case when minimum > maximum then 'minimum exceeds maximum' end, case when status = 'upcoming' and opens is null then 'upcoming needs opening' end, case when deadline <= opens then 'deadline before opening' end,
 case when status = 'open' and deadline < {TODAY} then 'passed deadline' end, case when status = 'open' and opens > {TODAY} then 'future opening' end], lambda x: x is not null), '; ') as violations from reviews""",
)
def review_validate(c):
    return L.review_validate(c["reviews"]).select("id", F.array_join("violations", "; ").alias("violations"))


BARE = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query("review_duplicates", f"select r.id, 'name' as by, min(o.id) as program from reviews r join opportunities o on {BARE.format('o.name')} = {BARE.format('r.name')} group by 1 union all select r.id, 'url', min(o.id) from reviews r join opportunities o on o.source_url = r.url group by 1")
def review_duplicates(c):
    return L.review_duplicates(c["reviews"], c["opportunities"])


@query("contribution_validate", f"select id, case when field not in ({', '.join(repr(f) for f in L.CONTRIBUTION_FIELDS)}) then 'field' when length(trim(proposed)) > 2000 then 'length' when (field = 'program') <> (opportunity_id = '') then 'program' when field <> 'program' and trim(proposed) = '' then 'proposal' end as violation from contributions")
def contribution_validate(c):
    return L.contribution_validate(c["contributions"]).select("id", "violation")


@query("contribution_rollup", "select c.id, c.state = 'decision' as decide, coalesce((select string_agg(s.proposed || ' ' || s.note, ', ' order by s.n, s.proposed, s.note) from contribution_submissions s where s.contribution_id = c.id), '') as submissions from contributions c")
def contribution_rollup(c):
    each = F.array_join(F.transform("submissions", lambda s: F.concat_ws(" ", s["proposed"], s["note"])), ", ")
    return L.contribution_rollup(c["contributions"], c["contribution_submissions"]).select("id", "decide", F.coalesce(each, F.lit("")).alias("submissions"))


# ---- reports ---------------------------------------------------------------------------


@query("queue_stats", f"select count(*) filter (where status in ('queued', 'running')) as waiting, count(*) filter (where status in ('queued', 'running') and created_at < {NOW} - interval 24 hour) as overdue, count(*) filter (where status in ('complete', 'partial') and finished_at > {NOW} - interval 24 hour) as finished, max(last_served_at) as last_served_at from search_jobs")
def queue_stats(c):
    return L.queue_stats(c["search_jobs"])


@query("ledger_stats", f"select count(*) as attempts, cast(coalesce(sum(reserved_cents), 0) as bigint) as reserved_cents, count(*) filter (where status = 'failed') as failures, max(created_at) as last_attempt, cast(coalesce(sum(queued_count), 0) as bigint) as queued_links, cast(coalesce(sum(domain_count), 0) as bigint) as suggested_domains from research_ledger where created_at >= date_trunc('month', {NOW}) and created_at <= {NOW}")
def ledger_stats(c):
    return L.ledger_stats(c["research_ledger"])


@query(
    "reconcile_summary",
    f"""with i as (select run_id, count(*) as inventory, count(*) filter (where status = 'complete' and reason <> 'Continued in newer inventory') as checked, count(*) filter (where reason = 'Continued in newer inventory') as continued_elsewhere, count(*) filter (where status in ('queued', 'running')) as unchecked,
  count(*) filter (where status = 'blocked') as retry_scheduled, count(*) filter (where status = 'ambiguous') as research_needed, count(*) filter (where status = 'blocked' and next_attempt_at <= {NOW}) as overdue_retries from reconcile_items group by 1),
 e as (select run_id, count(*) filter (where action = 'merged') as merged, count(*) filter (where action = 'hidden') as hidden, cast(coalesce(sum(case when action = 'facts-resolved' and regexp_matches(detail, '^[0-9]+$') then try_cast(detail as bigint) end), 0) as bigint) as facts_resolved from reconcile_events group by 1)
 select i.*, coalesce(merged, 0) as merged, coalesce(hidden, 0) as hidden, coalesce(facts_resolved, 0) as facts_resolved, case when unchecked > 0 then 'partial' else 'complete' end as status from i left join e on e.run_id = i.run_id""",
)
def reconcile_summary(c):
    return L.reconcile_summary(c["reconcile_items"], c["reconcile_events"])


@query("field_history_recent", "select opportunity_id, field, id, cast(place as int) as place, latest from (select *, row_number() over (partition by opportunity_id order by created_at desc, id desc) as place, row_number() over (partition by opportunity_id, field order by created_at desc, id desc) = 1 as latest from catalog_field_history) where place <= 20")
def field_history_recent(c):
    return L.field_history_recent(c["catalog_field_history"]).select("opportunity_id", "field", "id", "place", "latest")


@query(
    "field_rollback",
    """with last as (select opportunity_id, field, old_value, new_value from (select *, row_number() over (partition by opportunity_id, field order by created_at desc, id desc) as n from catalog_field_history) where n = 1)
 select f.opportunity_id, f.field, case when l.opportunity_id is null then 'no history' when f.value is distinct from l.new_value then 'changed since' else 'rolled back' end as outcome,
 case when l.opportunity_id is not null and f.value is not distinct from l.new_value then l.old_value else f.value end as value, f.locked or (l.opportunity_id is not null and f.value is not distinct from l.new_value) as locked from catalog_fields f left join last l on l.opportunity_id = f.opportunity_id and l.field = f.field""",
)
def field_rollback(c):
    return L.field_rollback(c["catalog_fields"], c["catalog_field_history"], c["catalog_fields"])


@query(
    "admin_stats",
    f"""select (select count(*) from opportunities where not is_demo and {LIVE}) as published, (select count(distinct url) from crawl_candidates where status = 'pending' and kind = 'domain') as domains, (select count(*) from catalog_fields where state = 'locked_conflict') as locked,
 (select count(*) from catalog_field_history where action = 'automatic' and old_value is null) as facts_resolved, (select count(*) from publication_results where outcome = 'published') as published_pages, (select count(*) from publication_results where outcome = 'updated') as updated_pages, (select count(*) from publication_results where outcome = 'skipped') as skipped_pages""",
)
def admin_stats(c):
    return L.admin_stats(c["opportunities"], c["crawl_candidates"], c["catalog_fields"], c["catalog_field_history"], c["publication_results"])


@query("paged_leads", f"select c.id, c.url, (select count(*) from crawl_candidates c where {LEAD} and {UNALIASED}) as total from crawl_candidates c where {LEAD} and {UNALIASED} order by c.id limit 12")
def paged_leads(c):
    """Leads that pass both filters, a page of them with their number."""
    leads = L.unaliased_leads(c["crawl_candidates"], c["opportunities"], c["opportunity_source_urls"], c["catalog_monitoring"])
    leads = L.lead_filter(leads, c["crawl_snapshots"], c["publication_results"])
    return C.paged_total(leads, [F.col("id")], 1, 12).select("id", "url", "total")
