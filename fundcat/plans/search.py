"""The registered unified search, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.functions import roles as P
from fundcat.operators import search as S
from fundcat.plans.base import NOW, query
from fundcat.plans.leads import UNALIASED
from fundcat.plans.registry import RANK, WIDE

WHO = S.Applicant("nonprofit", ("Music", "Research"), "United States", "New York")
GATED = "('directory', 'announcement', 'supporting', 'guidelines', 'faq', 'application')"
KEY = "regexp_replace(regexp_replace({0}, '^https?://(www\\.)?', 'https://'), '/+$', '')"


def _results(c):
    return c["feed_records"].withColumnRenamed("url", "source_url").withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-15 00:00:00")))


def cards(term: str = "fund", facets: str = "true", leads: str = "true", picked: str = "cast([] as varchar[])", external: str = "true") -> str:
    """All cards of a search, narrowed by a condition on programs, leads and results."""
    return f"""{WIDE}, nb as (select url, arg_max(body, (fetched_at, id)) as body from crawl_snapshots where fetched_at <= {NOW} group by 1), w0 as (select w.*, coalesce(nb.body, w.summary) as said from wide w left join nb on nb.url = w.source_url where contains(lower(name || ' ' || summary || ' ' || coalesce(funder, '') || ' ' || eligibility_notes || ' ' || array_to_string(categories, ' ')), '{term}') and {facets}),
 w1 as (select *, {P.role_sql('name', 'source_url', 'said')} as role, {P.role_sql('name', "(regexp_extract(source_url, '^https?://[^/?#]+') || '/program')", 'said')} = 'program' as named from w0), w2 as (select * from w1 where role not in {GATED} or named),
 gr as (select g.opportunity_id, g.rule, g.seq, coalesce(g.country, g.state, g.city) is not null as named, case when g.city is not null then 'Available in ' || g.city when g.state is not null then 'Available in ' || g.state when gc = '' then 'Accepts applicants worldwide' when gc = 'United States' then 'Accepts applicants nationwide' else 'Available in ' || gc end as fit,
  case when (gc <> '' and gc <> 'United States') or (g.state is not null and g.state <> 'New York') then 'different' when g.city is not null then 'unknown' else 'matches' end as rel from (select *, case when country is null or country = 'Worldwide' then '' else country end as gc from opportunity_geographies) g),
 gs as (select opportunity_id, case when bool_or(rule = 'excluded' and rel = 'matches') then 'excluded' when bool_or(rule = 'eligible' and named and rel = 'matches') and not bool_or(rule = 'excluded' and rel = 'unknown') then 'eligible' when bool_or(rule = 'eligible' and named) and not bool_or(rule = 'eligible' and named and rel <> 'different') then 'excluded' else 'unknown' end as geo, arg_min(fit, seq) filter (where rule = 'eligible' and named and rel = 'matches') as fit from gr group by 1),
 cc as (select w2.id, 'catalog' as kind, case when role = 'ambiguous' and verification_status <> 'verified' and not regexp_matches(name, '(?i){P.PROGRAM_TITLE}') then 'research' else 'program' end as record_type, name, summary, source_url as url, status, current_deadline, maximum_award, categories, applicants, coalesce(geo, 'unknown') as geo, verification_status = 'verified' as verified, created_at as since from w2 left join gs on gs.opportunity_id = w2.id),
 lc as (select cast(id as varchar) as id, 'lead' as kind, case when role = 'program' then 'program' else 'research' end as record_type, title as name, summary, url, 'unknown' as status, cast(null as date) as current_deadline, cast(null as double) as maximum_award, categories, cast([] as varchar[]) as applicants, 'unknown' as geo, false as verified, fetched_at as since
  from (select *, {P.role_sql('title', 'url', 'body')} as role from (select c.id, c.url, c.title, s.body, s.fetched_at, substr(s.body, 1, 600) as summary, r.name as source_name, case when r.id is null then [] else [r.c1, r.c2] end as categories, row_number() over (partition by c.url order by s.fetched_at desc, c.id) as n from crawl_candidates c join crawl_snapshots s on s.id = c.snapshot_id left join source_registry r on r.id = c.source_id where {UNALIASED})
  where n = 1 and contains(lower(title || chr(10) || summary || chr(10) || coalesce(source_name, '') || chr(10) || array_to_string(categories, ' ')), '{term}') and {leads}) where role in ('program', 'ambiguous')),
 ec as (select provider || ':' || external_id as id, 'external' as kind, 'program' as record_type, title as name, content as summary, url, 'unknown' as status, cast(null as date), cast(null as double), cast([] as varchar[]), cast([] as varchar[]), 'unknown' as geo, false, timestamp '2024-01-15 00:00:00' from feed_records f where contains(lower(title || ' ' || content), '{term}') and {external}
  and not exists (select 1 from opportunities o where rtrim(o.source_url, '/') = rtrim(f.url, '/')) and not exists (select 1 from opportunity_source_urls a where rtrim(a.url, '/') = rtrim(f.url, '/')) and not exists (select 1 from provider_records p where p.provider = f.provider and p.external_id = f.external_id)),
 ac as (select *, {KEY.format('url')} as own from (select * from cc union all select * from lc union all select * from ec)), nm as (select {KEY.format('a.url')} as own, min({KEY.format('cc.url')}) as program_key from opportunity_source_urls a join cc on cc.id = a.opportunity_id group by 1),
 kc as (select ac.*, row_number() over (partition by coalesce(program_key, ac.own) order by case when kind <> 'catalog' then 2 when verified then 0 else 1 end, since, id) as n from ac left join nm on nm.own = ac.own), one as (select * from kc where n = 1),
 jd as (select *, list_intersect(categories, case when kind = 'catalog' then {picked} else ['Music', 'Research'] end) as shared, list_contains(applicants, 'nonprofit') as fits from one), sc as (select *, case when kind = 'lead' then 0 else len(shared) + case when fits then 1 else 0 end + case when geo = 'eligible' then 1 else 0 end end as matches, case when kind = 'lead' then 0 else case when len(applicants) > 0 and not fits then 1 else 0 end end as conflicts,
  3 * case when contains(lower(name), '{term}') then 1 else 0 end + case when contains(lower(summary), '{term}') then 1 else 0 end as relevance from jd)"""


def page_of(cards_: str, kind: str, page: int) -> str:
    """A page of 12 of one kind, the last one for a page past the end."""
    return f"""with {cards_}, st as (select * from sc where geo <> 'excluded'), tt as (select count(*) filter (where record_type = 'program') as programs, count(*) filter (where record_type = 'research') as research, count(*) filter (where record_type = '{kind}') as total from st),
 un as (select count(*) filter (where record_type = 'program' and geo = 'eligible') as eligible_programs, count(*) filter (where record_type = '{kind}' and geo = 'unknown') as location_unknown from sc),
 pl as (select *, row_number() over (order by conflicts, {RANK}, matches desc, relevance desc, current_deadline asc nulls last, name, id) as place from st where record_type = '{kind}')
 select id, kind, name, geo, cast(matches as bigint) as matches, cast(conflicts as bigint) as conflicts, cast(relevance as bigint) as relevance, array_to_string(list_sort(categories), ',') as categories, programs, research, eligible_programs, location_unknown, cast(least({page}, greatest(1, ceil(total / 12.0))) as bigint) as page
 from pl, tt, un where ceil(place / 12.0) = least({page}, greatest(1, ceil(total / 12.0)))"""


def _page(df):
    return df.select("id", "kind", "name", "geo", "matches", "conflicts", "relevance", F.array_join(F.array_sort("categories"), ",").alias("categories"), "programs", "research", "eligible_programs", "location_unknown", "page")


@query("unified_search", page_of(cards(), "program", 2))
def unified_search(c):
    return _page(S.unified_search(c, _results(c), WHO, "fund", page=2))


@query("unified_search_research", page_of(cards("music", "list_has_any(categories, ['Music', 'Research'])", "list_has_any(categories, ['Music', 'Research'])", "['Music', 'Research']", "false"), "research", 99))
def unified_search_research(c):
    """Research pages of two categories: leads by their source; past the end, the last page."""
    return _page(S.unified_search(c, _results(c), WHO, "music", "research", page=99, wish=S.Wish(categories=("Music", "Research"))))


@query("unified_search_open", page_of(cards("fund", "status = 'open' and maximum_award >= 950", "false", external="false"), "program", 1))
def unified_search_open(c):
    """Open programs with an award: no lead and no result is known to be either."""
    return _page(S.unified_search(c, _results(c), WHO, "fund", wish=S.Wish(status="open", min_award=950)))


@query("external_cards", f"with {cards()} select id, name, summary, url from ec")
def external_cards(c):
    return S.external_cards(_results(c), c["opportunities"], c["opportunity_source_urls"], c["provider_records"], "fund").select("id", F.col("title").alias("name"), "summary", "url")
