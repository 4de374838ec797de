"""Registered queries of the evidence operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.functions import places as W
from fundcat.functions import roles as P
from fundcat.operators import catalog as C
from fundcat.operators import evidence as E
from fundcat.plans.base import query
from fundcat.schema import COUNTRIES, STATES

_STATES = "states(code, name) as (values " + ", ".join(f"('{c.lower()}', '{n}')" for c, n in STATES) + ")"
_KNOWN = "[" + ", ".join(f"'{c.lower()}'" for c in COUNTRIES) + "]"


def _state(x: str) -> str:
    return f"(select any_value(name) from states s where s.code = lower(trim({x})) or lower(s.name) = lower(trim({x})))"


def _country(x: str) -> str:
    return f"case when regexp_full_match(trim({x}), '(?i)us|usa|u\\.s\\.|united states( of america)?') then 'United States' when regexp_full_match(trim({x}), '(?i)uk|gb|great britain|united kingdom') then 'United Kingdom' when regexp_full_match(trim({x}), '(?i)worldwide|global|international') then 'Worldwide' else trim({x}) end"


PLACED = f"""{_STATES}, t as (select id, regexp_replace(trim(phrase), '(?i)^the ', '') as t from phrases), p as (select *, list_transform(string_split(t, ','), lambda x: trim(x)) as parts from t),
 q as (select *, {_state("regexp_replace(t, '(?i) State$', '')")} as st, {_state("parts[2]")} as second, {_country("parts[-1]")} as country from p),
 placed as (select id, case when regexp_full_match(t, '(?i)[a-z]{{2}}') then null when regexp_full_match(t, '(?i)worldwide|global|international') then ['Worldwide', null, null] when lower(t) = 'new york city' then ['United States', 'New York', 'New York City']
  when st is not null and list_contains({_KNOWN}, lower(t)) then null when st is not null then ['United States', st, null] when len(parts) = 2 and second is not null then ['United States', second, parts[1]] when not list_contains({_KNOWN}, lower(country)) or len(parts) > 3 then null
  when len(list_filter(parts, lambda x: regexp_matches(x, '(?i)\\b(and|or|except|excluding|within|outside|only if)\\b'))) > 0 then null when len(parts) = 1 then [country, null, null] when len(parts) = 2 then null else [country, case when country = 'United States' then coalesce(second, parts[2]) else parts[2] end, parts[1]] end as x from q)"""


@query("explicit_place", f"with {PLACED} select id, x[1] as country, x[2] as state, x[3] as city from placed")
def explicit_place(c):
    return c["phrases"].select("id", W.explicit_place(F.col("phrase")).alias("p")).select("id", "p.country", "p.state", "p.city")


@query(
    "source_scope",
    f"""with n as (select *, list_transform(regexp_split_to_array(scope, '\\s*[,/|]\\s*'), lambda x: lower(trim(x))) as parts from scopes), m as (select *, list_transform(parts, lambda x: lower({_country("x")})) as nations from n),
 k as (select *, list_contains(nations, lower(country)) as here, len(list_filter(nations, lambda x: list_contains({_KNOWN}, x) or x = 'worldwide')) as known from m)
 select id, cast(case when country = '' then 1 when known = len(nations) and (here or list_contains(nations, 'worldwide')) then 2 when len(parts) = 1 and here then 2
  when not (here or (country = 'United States' and (known = 0 or (len(parts) = 1 and parts[1] = lower(state))))) then 0 when state <> '' and len(list_filter(nations, lambda x: x <> lower(country))) = 1 and list_contains(parts, lower(state)) then 3
  when city <> '' and list_contains(parts, lower(city)) and (state = '' or not here or len(parts) < 3 or list_contains(parts, lower(state))) then 4 when country = 'United States' and lower(scope) in ('national', 'nationwide') then 2 else 0 end as int) as priority from k""",
)
def source_scope(c):
    return c["scopes"].select("id", W.source_scope(F.col("scope"), F.col("country"), F.col("state"), F.col("city")).alias("priority"))


@query(
    "location_lines",
    """with l as (select id, list_filter(list_transform(regexp_split_to_array(lines, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') as rows from review_lines), r as (select id, unnest(rows) as line, generate_subscripts(rows, 1) as n from l where len(rows) between 1 and 60),
 p as (select *, list_transform(string_split(line, '|'), lambda x: trim(x)) as parts from r), b as (select id from p group by id having bool_or(line <> 'Worldwide' and (len(parts) > 3 or parts[1] = '')))
 select id, cast(n - 1 as int) as n, case when line <> 'Worldwide' then parts[1] end as country, nullif(parts[2], '') as state, nullif(parts[3], '') as city from p where id not in (select id from b)""",
    texts=("state", "city"),
)
def location_lines(c):
    return c["review_lines"].select("id", F.posexplode(W.location_lines(F.col("lines"))).alias("n", "p")).select("id", "n", "p.country", "p.state", "p.city")


@query("publisher_identity", """with u as (select id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as query from identity_urls)
 select id, case when host = 'nyfa.org' and contains(path, 'opportunity-info') and regexp_matches(query, '[?&]id=[^&]') then host || ':' || regexp_extract(query, '[?&]id=([^&]+)', 1) when host = 'grants.gov' and regexp_full_match(path, '/search-results-detail/[0-9]+/?') then host || ':' || regexp_extract(path, '[0-9]+')
 else 'https://' || host || case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end || query end as identity from u""")
def publisher_identity(c):
    return c["identity_urls"].select("id", E.publisher_identity(F.col("url")).alias("identity"))


def _says(verb: str) -> str:
    return f"nullif(regexp_extract(text, '(?i)(?:^|[.!?]\\s+)((?:this (?:grant|program|fund|fellowship)|the program|' || regexp_escape(name) || ') {verb}\\b[^.!?]*[.!?]?)', 1), '')"


@query(
    "lifecycle_signal",
    f"""with a as (select * from lifecycle_pages where contains(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) and length(regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) >= 8),
 f as (select id, {_says('(?:has been (?:permanently )?discontinued|is (?:permanently discontinued|no longer offered|permanently closed)|will no longer be offered)')} as ended, {_says('(?:is (?:now |once again )?(?:accepting applications|open for applications)|has (?:reopened|resumed))')} as back from a),
 g as (select *, ended is not null and not regexp_matches(ended, '(?i)\\b(if|unless|might|may|could|until|this (year|cycle|round|season)|temporarily)\\b') as e, back is not null and not regexp_matches(back, '(?i)\\b(if|unless|might|may|could)\\b') as k from f)
 select id, case when e then 'discontinued' else 'active' end as state, case when e then ended else back end as evidence from g where e or k""",
)
def lifecycle_signal(c):
    return E.lifecycle_signal(c["lifecycle_pages"])


def _found(pattern: str) -> str:
    return f"select id, title, body, unnest(regexp_extract_all(body, '(?i){pattern}')) as m from s"


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = f"strftime(try_strptime(regexp_extract(m, '(?i)((?:{_MONTHS})\\s+\\d{{1,2}}),?\\s+(20\\d{{2}})', 1) || ' ' || regexp_extract(m, '(?i)(?:{_MONTHS})\\s+\\d{{1,2}},?\\s+(20\\d{{2}})', 1), '%B %d %Y'), '%Y-%m-%d')"
_MONEY = "cast(replace(regexp_extract(m, '\\$([\\d,]+)', 1), ',', '') as bigint)"
FACTS = f"""s as (select id, title, body from (select *, {P.role_sql('title', 'url', 'body')} as role from crawl_snapshots) where role not in ('directory', 'announcement', 'ambiguous')),
 fs as (select id, title, 'deadline' as field, regexp_extract(m, '20\\d{{2}}-\\d{{2}}-\\d{{2}}') as value, m from ({_found('(?:application deadline|applications due|deadline)\\s*:\\s*20\\d{2}-\\d{2}-\\d{2}\\b')})
 union all select id, title, 'deadline', {_DATE}, m from ({_found(f'(?:application deadline|applications (?:are )?due|deadline)\\s*(?::|is)?\\s*(?:{_MONTHS})\\s+\\d{{1,2}},?\\s+20\\d{{2}}\\b')})
 union all select id, title, 'opens', {_DATE}, m from ({_found(f'applications (?:will )?open\\s*:?\\s*(?:{_MONTHS})\\s+\\d{{1,2}},?\\s+20\\d{{2}}\\b')})
 union all select id, title, 'maximum', cast({_MONEY} as string), m from ({_found('(?:maximum grant amount|grant amounts? up to|maximum award|grants? of up to|budgets up to)\\s*:?\\s*(?:USD\\s*)?\\$[\\d,]+')})
 union all select id, title, f, cast(cast(replace(case f when 'minimum' then regexp_extract(m, '\\$([\\d,]+)', 1) else regexp_extract(m, '\\$[\\d,]+.*\\$([\\d,]+)', 1) end, ',', '') as bigint) as string), m from ({_found('(?:grant|award|funding) amounts?\\s*(?:range\\s*)?(?:from|of|between|:)?\\s*\\$[\\d,]+\\s*(?:to|[-–]|and)\\s*\\$[\\d,]+')}) cross join (values ('minimum'), ('maximum')) as v(f)
 union all select id, title, f, case f when 'rolling' then 'true' else 'open' end, m from ({_found('applications (?:are )?(?:accepted|reviewed) (?:on a rolling basis|year[- ]round)|(?:application )?deadline\\s*:\\s*rolling')}) cross join (values ('rolling'), ('status')) as v(f) where f = 'rolling' or regexp_matches(m, '(?i)accepted')
 union all select id, title, 'status', case when regexp_matches(m, '(?i)closed|not being accepted') then 'closed' else 'open' end, m from ({_found('(?:[^.!?\\n]{0,65}\\b)?applications (?:are |are currently |currently |now )?(?:open|closed|being accepted|not being accepted)\\b[^.!?\\n]{0,100}[.!?]?')}) where not regexp_matches(m, '(?i)applications open\\s*:?\\s*(?:{_MONTHS}|\\d)') and not regexp_matches(m, '(?i)\\b(were|was|previous|last year|will|opens|historical)\\b')
 union all select id, title, 'recurrence', case when regexp_matches(m, '(?i)(annually|every year|each year)$') then 'annual' else 'recurring' end, m from ({_found('(?:this |the )(?:grant|program|fellowship|award)(?: program)? (?:is (?:offered|awarded|available)|runs|accepts applications) (?:annually|every year|each year|twice a year|quarterly|monthly)\\b')})
 union all select id, title, f, case f when 'eligibility' then rtrim(m) else '["nonprofit","student"]' end, rtrim(m) from ({_found('(?:eligible applicants (?:include|are)|(?:this (?:grant|program) is )?open to|applicants must be)\\s+[^.!?\\n]{5,900}(?:[.!?](?:\\s|$)|$)')}) cross join (values ('eligibility'), ('applicants')) as v(f) where not regexp_matches(m, '(?i)\\b(not|except|excluding|ineligible)\\b')
 union all select id, title, 'geography', case p when 'New York' then '{{"country":"United States","state":"New York"}}' when 'Canada' then '{{"country":"Canada"}}' when 'New York City' then '{{"country":"United States","state":"New York","city":"New York City"}}' when 'Austin, Texas' then '{{"country":"United States","state":"Texas","city":"Austin"}}' end, m from (select *, regexp_extract(m, '(?i) in ([^.!?\\n]{{2,150}})[.!?]', 1) as p from ({_found('(?:applicants must (?:reside|be based|be located)|eligible applicants (?:reside|are based)) in [^.!?\\n]{2,150}(?:[.!?]|$)')})) where p <> 'the river valley'
 ), opening as (select id, title, 'status' as field, 'unknown' as value, min(m) as m from fs where field = 'opens' and id not in (select id from fs where field = 'status') group by 1, 2),
 every as (select *, false as conflict from fs union all select *, true from opening), due as (select id, min(m) as m from fs where field = 'deadline' group by id having count(*) = 1),
 years as (select e.*, regexp_extract(title, '20\\d{{2}}') as t, list_distinct(regexp_extract_all(e.m, '\\b20\\d{{2}}\\b')) as y, list_distinct(regexp_extract_all(d.m, '\\b20\\d{{2}}\\b')) as yd from every e left join due d on d.id = e.id),
 stated as (select id, field, value, m as excerpt, coalesce(nullif(t, ''), case len(y) when 0 then null when 1 then y[1] else 'unresolved' end, case coalesce(len(yd), 0) when 0 then null when 1 then yd[1] else 'unresolved' end) as cycle, conflict from years)"""


@query("text_facts", f"with {FACTS} select id, field, value, case when field <> 'status' then excerpt end as excerpt, cycle, conflict from stated")
def text_facts(c):
    facts = E.text_facts(c["crawl_snapshots"])
    return facts.select("id", "field", "value", F.when(F.col("field") != "status", F.col("excerpt")).alias("excerpt"), "cycle", "conflict")


# ---- pages of programs -----------------------------------------------------------

_ID = """regexp_replace(regexp_replace({0}, '^https?://(www\\.)?', 'https://'), '/+$', '')"""
RELATED = f"""pg as (select c.id, c.url, s.body, {_ID.format("c.url")} as identity, regexp_extract(c.url, '^https?://(?:www\\.)?([^/?#]+)', 1) as host, regexp_extract(c.url, '^https?://[^/?#]+([^?#]*)', 1) as path, {P.role_sql('s.title', 'c.url', 's.body')} in ('application', 'guidelines', 'faq', 'supporting') as adds from page_urls c join crawl_snapshots s on s.id = c.snapshot_id),
 pr as (select id as opportunity_id, name, source_url, {_ID.format("source_url")} as identity, regexp_extract(source_url, '^https?://(?:www\\.)?([^/?#]+)', 1) as host, regexp_extract(source_url, '^https?://[^/?#]+([^?#]*)', 1) as parent from opportunities),
 ways as (select pg.id as page_id, opportunity_id, 'explicit-program-identifier' as association, 0 as o from pg join pr using (identity) union all select pg.id, opportunity_id, 'official-program-subpage', 1 from pg join pr on pg.host = pr.host and adds and pr.parent <> '' and starts_with(pg.path, pr.parent || '/')
  union all select pg.id, opportunity_id, 'official-program-link', 2 from pg join pr on pg.host = pr.host and adds and length(name) >= 12 and contains(lower(body), lower(name)) join (select distinct url, link from page_links) l on l.url = pr.source_url and l.link = pg.url),
 related as (select page_id, opportunity_id, arg_min(association, o) as association from ways group by 1, 2)"""


def _related(c):
    pages = c["page_urls"].join(c["crawl_snapshots"].select(F.col("id").alias("snapshot_id"), "title", "body"), "snapshot_id")
    return E.related_pages(pages, c["opportunities"], c["page_links"])


@query("related_pages", f"with {RELATED} select * from related")
def related_pages(c):
    return _related(c)


def _attached(c):
    pages = c["page_urls"].select("id", "url", "fetched_at")
    facts = E.text_facts(c["page_urls"].drop("fetched_at").join(c["crawl_snapshots"].select(F.col("id").alias("snapshot_id"), "title", "body", "fetched_at"), "snapshot_id").select("id", "url", "title", "body", "fetched_at"))
    return E.attach_evidence(_related(c), pages, facts, c["evidence_pages"]), facts


@query("attach_evidence")
def attach_evidence(c):
    return _attached(c)[0][0].drop("fetched_at")


@query("round_history")
def round_history(c):
    (_, rounds, _), facts = _attached(c)
    return E.round_history(C.merge_families(c["opportunities"]), rounds, facts)
