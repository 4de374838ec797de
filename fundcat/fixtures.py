"""Catalog tables as views over the driver's tables.

Each view is one SELECT in the dialect that Spark and DuckDB share. Spark builds the
views a query needs as DataFrames; ``with_views`` puts the same text before an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fundcat.schema import APPLICANT_TYPES, AS_OF, CATEGORIES

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
#: How much larger rows are than their files, at most, for choosing joins.
FACTOR, COMPRESSED = "spark.sql.sources.fileCompressionFactor", 100.0
_NOW = f"timestamp '{AS_OF}'"


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))


VIEWS: dict[str, str] = {
    "funders": "select 'f' || cast(s_suppkey as string) as id, s_name as name from supplier",
    "category_names": f"select * from (values {_list(CATEGORIES)}) as t(n, name)",
    "applicant_names": f"select * from (values {_list(APPLICANT_TYPES)}) as t(n, name)",
    "opportunities": f"""select 'o' || cast(p_partkey as string) as id, p_partkey as k,
        p_name || ' ' || p_type || ' Grant' || case when p_partkey % 5 = 0 then ' 2024' else '' end as name,
        'Funding for ' || p_name || ' projects' || case p_partkey % 7 when 1 then ' led by women' when 2 then ' in rural areas' when 3 then ' for veterans' when 4 then ' for low-income youth' else '' end as summary,
        case when p_partkey % 8 = 0 then 'Unknown' else 'Applicants in ' || p_brand end as eligibility_notes,
        'f' || cast(p_partkey % 10 as string) as funder_id,
        'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(case when p_partkey % 50 = 21 then p_partkey - 20 else p_partkey end as string) || case when p_partkey % 50 = 21 and p_partkey % 100 > 50 then '/apply-now/' else '' end as source_url,
        case p_size % 5 when 0 then 'open' when 1 then 'upcoming' when 2 then 'closed' when 3 then 'unknown' else 'open' end as application_status,
        case when p_partkey % 4 <> 0 then date '2024-01-31' + cast(p_partkey % 121 - 60 as int) end as deadline,
        case when p_partkey % 6 = 0 then date '2024-01-31' + cast(p_partkey % 41 - 20 as int) end as opens,
        p_partkey % 17 = 0 as rolling,
        case p_partkey % 3 when 0 then 'annual' when 1 then 'recurring' end as recurrence,
        case when p_partkey % 5 <> 0 then p_retailprice end as maximum_award,
        case when p_partkey % 5 = 0 or p_partkey % 3 = 1 then null when p_partkey % 3 = 2 then p_retailprice else p_retailprice / 2 end as minimum_award,
        case when p_partkey % 23 = 0 then 'hidden' else 'published' end as publication_state,
        p_partkey % 97 = 0 as is_demo,
        case when p_partkey % 43 = 0 then 'archived' else 'verified' end as verification_status,
        case when p_partkey % 31 = 0 and cast(floor(p_partkey / 31) as bigint) % 40 <> 0 then 'o' || cast(p_partkey - 31 as string) end as merged_into,
        {_NOW} - (p_partkey % 120) * interval '1' day as last_checked_at,
        {_NOW} - (p_partkey % 30) * interval '1' day as created_at,
        {_NOW} - (p_partkey % 12) * interval '1' day as catalog_updated_at
        from part""",
    "catalog_monitoring": f"""select 'o' || cast(p_partkey as string) as opportunity_id, case when p_partkey % 13 = 0 then 'discontinued' else 'active' end as state,
        cast(p_partkey % 6 as int) as consecutive_failures, case when p_partkey % 26 <> 5 then {_NOW} - (p_partkey % 9) * interval '1' day end as last_success_at
        from part where p_partkey % 13 in (0, 5)""",
    "opportunity_categories": "select 'o' || cast(p_partkey as string) as opportunity_id, c.name as category from part join (values (0), (3), (7)) as x(o) on true join category_names c on c.n = (p_partkey + x.o) % 14",
    "opportunity_applicant_types": "select 'o' || cast(p_partkey as string) as opportunity_id, a.name as applicant_type from part join (values (0), (4)) as x(o) on true join applicant_names a on a.n = (p_partkey + x.o) % 9 where p_partkey % 6 <> 0",
    "opportunity_geographies": """select 'o' || cast(p_partkey as string) as opportunity_id, o as seq,
        case (p_partkey + 3 * o) % 7 when 0 then 'Worldwide' when 4 then 'Canada' when 5 then null else 'United States' end as country,
        case (p_partkey + 3 * o) % 7 when 2 then 'New York' when 3 then 'California' when 4 then 'Ontario' when 6 then 'Texas' end as state,
        case (p_partkey + 3 * o) % 7 when 2 then 'New York City' when 6 then 'Austin' end as city,
        case when (p_partkey + o) % 13 = 0 then 'excluded' else 'eligible' end as rule
        from part join (values (0), (1)) as x(o) on true""",
    "opportunity_source_urls": """select 'o' || cast(p_partkey as string) as opportunity_id, 'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(p_partkey as string) || case when x.o = 1 then '/faq' else '' end as url
        from part join (values (0), (1)) as x(o) on true where x.o = 0 or p_partkey % 9 = 0""",
    "profiles": """select 'w' || cast(c_custkey as string) as workspace_id, c_name as name,
        case c_mktsegment when 'BUILDING' then 'nonprofit' when 'AUTOMOBILE' then 'business' when 'MACHINERY' then 'organization' when 'HOUSEHOLD' then 'individual' else 'researcher' end as applicant_type,
        case c_nationkey % 4 when 2 then 'Canada' when 3 then null else 'United States' end as country,
        case c_nationkey % 4 when 0 then 'New York' when 1 then 'California' when 2 then 'Ontario' end as state,
        case c_nationkey % 4 when 0 then 'New York City' end as city from customer""",
    "profile_categories": "select 'w' || cast(c_custkey as string) as workspace_id, c.name as category from customer join (values (0), (5)) as x(o) on true join category_names c on c.n = (c_custkey + x.o) % 14",
    "workspace_members": f"select 'u' || cast(o_custkey % 500 as string) as user_id, 'w' || cast(o_custkey as string) as workspace_id, min(cast(o_orderdate as timestamp)) as created_at from orders group by o_custkey",
    "saved_opportunities": "select 'w' || cast(o_custkey as string) as workspace_id, 'o' || cast(o_orderkey % n as string) as opportunity_id, min(cast(o_orderdate as timestamp)) as saved_at from orders cross join (select count(*) as n from part) as parts where o_orderstatus = 'F' group by o_custkey, o_orderkey % n",
    "applications": """select 'a' || cast(o_orderkey as string) as id, 'w' || cast(o_custkey as string) as workspace_id, case when o_orderkey % 3 <> 0 then 'o' || cast(o_orderkey % n as string) end as opportunity_id,
        'https://src' || cast(o_orderkey % 20 as string) || '.example.org/programs/' || cast(o_orderkey % n as string) as source_url,
        case when o_orderstatus = 'F' then 'awarded' when o_orderstatus = 'P' then 'submitted' when o_orderkey % 2 = 0 then 'preparing' else 'saved' end as stage,
        o_totalprice as requested, cast(o_orderdate as date) + 30 as target_date, o_orderkey % 19 = 0 as archived, cast(o_orderdate as timestamp) as created_at from orders cross join (select count(*) as n from part) as parts""",
    "grant_tasks": "select 't' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as id, 'a' || cast(l_orderkey as string) as application_id, cast(l_shipdate as date) as due, l_returnflag = 'R' as completed, l_linenumber = 7 as deleted from lineitem",
    "application_preparation": "select 'a' || cast(l_orderkey as string) as application_id, case l_linenumber % 3 when 0 then 'budget' when 1 then 'answer' else 'other' end as kind, l_extendedprice as cost, l_extendedprice * (1 - l_discount) as requested, l_linestatus = 'F' as archived from lineitem",
    "facts": """select 'o' || cast(l_partkey as string) as opportunity_id, case (l_linenumber + l_suppkey) % 11 when 0 then 'status' when 1 then 'deadline' when 2 then 'maximum' when 3 then 'rolling' when 4 then 'recurrence' when 5 then 'opens' when 6 then 'minimum' when 7 then 'categories' when 8 then 'eligibility' when 9 then 'applicants' else 'geography' end as field,
        case (l_linenumber + l_suppkey) % 11 when 0 then case when l_quantity < 35 then 'open' else 'closed' end when 1 then case when l_quantity < 30 then '2024-01-10' else '2024-05-01' end when 2 then case when l_quantity < 40 then '10000' else '25000' end when 3 then 'true' when 4 then 'annual' when 5 then case when l_quantity < 25 then '2024-01-05' else '2024-03-01' end when 6 then case when l_quantity < 40 then '500' else '1000' end when 7 then 'Music' when 8 then case when l_quantity < 45 then 'Residents may apply.' else 'Members may apply.' end when 9 then 'nonprofit' else case when l_quantity < 20 then 'Canada' else 'United States' end end as value,
        case when l_orderkey % 5 = 0 then null when l_orderkey % 11 = 0 then 'unresolved' else cast(2022 + l_orderkey % 4 as string) end as cycle, l_tax = 0.08 as conflict from lineitem""",
    "slots": "select doc_id, text, source, n_chars, doc_id % greatest(1, cast(floor(n / 3) as bigint)) as r, greatest(1, cast(floor(n / 3) as bigint)) as slots from documents cross join (select count(*) as n from documents) as t",
    "snapshot_bodies": """select doc_id, r, coalesce(text, '') || ' ' || case doc_id % 12 when 0 then 'Applications are open.' when 1 then 'Applications are closed.' when 2 then 'Deadline: 2024-05-01.' when 3 then 'The application deadline is May ' || cast(1 + doc_id % 28 as string) || ', 2024.'
        when 4 then 'Grant amounts range from $' || cast(500 * (1 + doc_id % 7) as string) || ' to $5,000.' when 5 then 'Maximum award: $' || cast(1 + doc_id % 9 as string) || ',500.' when 6 then 'Applications are accepted on a rolling basis.' when 7 then 'The program is offered annually.'
        when 8 then 'Applicants must reside in ' || case doc_id % 5 when 0 then 'New York' when 1 then 'Canada' when 2 then 'New York City' when 3 then 'Austin, Texas' else 'the river valley' end || '.' when 9 then 'Eligible applicants include nonprofit organizations and students.' when 10 then 'Applications open: March 1, 2024.' else '' end as body from slots""",
    "crawl_snapshots": f"""select doc_id as id, 'https://src' || cast(r % 20 as string) || '.example.org/programs/' || cast(r as string) as url,
        {_NOW} - (doc_id % 100) * interval '1' day as fetched_at, md5(body) as content_hash, 'v' || cast(doc_id % 3 as string) as extractor,
        case doc_id % 16 when 0 then 'Rural Arts Fund ' || cast(r as string) when 1 then 'River Fellowship Program' when 2 then 'Grants' when 3 then 'How to write a grant' when 4 then 'FAQ for applicants' when 5 then 'Grant guidelines' when 6 then 'Award recipients 2023' when 7 then 'Funding opportunities'
         when 8 then 'Apply for the River Grant' when 9 then 'Contact us' when 10 then 'Who can apply?' when 11 then 'Terms and conditions' when 12 then 'Grant recap' when 13 then 'Music Fund ' || cast(r as string) when 14 then '"Community Award 2024"' else 'Top 10 grants for artists' end as title, body from snapshot_bodies
        union all select -1 - doc_id, 'https://src' || cast(r % 20 as string) || '.example.org/programs/' || cast(r as string), {_NOW} - (doc_id % 100) * interval '1' day + interval '6' hour, md5(body), 'v' || cast(doc_id % 3 as string), 'Program ' || cast(r as string), body from snapshot_bodies where doc_id % 2 = 1""",
    "crawl_sources": "select source as id, 'https://' || source || '.example.org/' as url, source || '.example.org' as domain, min(doc_id) % 7 <> 0 as enabled from documents group by source",
    "crawl_visits": "select event_id as id, date_trunc('hour', cast(ts as timestamp)) as run, 'src' || cast(user_id % 20 as string) as source_id, 'o' || cast(user_id as string) as opportunity_id, cast(ts as timestamp) as ts, case event_type when 'error' then 'failed' when 'signup' then 'discontinued' when 'purchase' then 'reopened' else 'read' end as outcome from events",
    "asof_events": "select event_id, cast(ts as timestamp) as ts, 'https://src' || cast((event_id % slots) % 20 as string) || '.example.org/programs/' || cast(event_id % slots as string) as url from events cross join (select max(slots) as slots from slots) as t",
    "request_attempts": "select event_id as id, user_id as key, cast(ts as timestamp) as ts from events",
    "crawl_candidates": f"""select d.doc_id as id, d.doc_id as snapshot_id, source as source_id, 'https://src' || cast(d.r % 20 as string) || '.example.org/' || case d.doc_id % 6 when 0 then 'news/' when 1 then 'guidelines/' else 'programs/' end || cast(d.r as string) as url,
        md5(body) as content_hash, case d.doc_id % 9 when 0 then 'domain' when 1 then 'changed' else 'new' end as kind, case d.doc_id % 11 when 0 then 'rejected' else 'pending' end as status,
        case d.doc_id % 5 when 0 then 'How to write a grant' when 1 then 'Grants' when 2 then 'Rural Arts Fund ' || cast(d.r as string) when 3 then 'River Fellowship Program' else 'Contact us' end as title,
        case when d.doc_id % 7 = 0 then 'o' || cast(d.r as string) end as opportunity_id, {_NOW} - (d.doc_id % 40) * interval '1' day as created_at from slots d join snapshot_bodies b on b.doc_id = d.doc_id""",
    "publish_candidates": f"""select d.doc_id as id, d.doc_id as snapshot_id, 'src' || cast(d.r % 20 as string) as source_id, 'https://src' || cast((d.r + case when d.doc_id % 19 = 0 then 1 else 0 end) % 20 as string) || '.example.org/programs/' || case d.doc_id % 10 when 0 then cast(d.r as string) when 1 then cast(d.r as string) || '/application' when 2 then cast(d.r as string) || '/faq' else 'new/' || cast(d.doc_id as string) end as url,
        case when d.doc_id % 13 = 0 then md5('old') else md5(body) end as content_hash, case d.doc_id % 17 when 0 then 'domain' else 'new' end as kind, case d.doc_id % 11 when 0 then 'rejected' else 'pending' end as status,
        case d.doc_id % 8 when 0 then 'Rural Arts Fund ' || cast(d.doc_id as string) when 1 then 'Rural Arts Fund' when 2 then coalesce(o.name, 'Fund of nothing') when 3 then 'Grants' when 4 then 'FAQ for applicants' when 5 then 'How to write a grant' when 6 then 'River Fellowship Program' else 'Music Fund ' || cast(d.doc_id as string) end as title,
        case when d.doc_id % 7 = 0 then 'o' || cast(d.r as string) end as opportunity_id, {_NOW} - (d.doc_id % 40) * interval '1' day as created_at from slots d join snapshot_bodies b on b.doc_id = d.doc_id left join opportunities o on o.k = d.r""",
    "publish_snapshots": f"""select c.id, c.url, {_NOW} - (c.id % 100) * interval '1' day as fetched_at, md5(b.body) as content_hash, b.body || case when c.id % 9 = 5 then '' else ' Apply for funding. This grant supports projects and provides awards to applicants.' end as body from publish_candidates c join snapshot_bodies b on b.doc_id = c.id""",
    "publication_results": "select doc_id as candidate_id, case doc_id % 6 when 0 then 'skipped' when 3 then 'published' else 'updated' end as outcome, case doc_id % 12 when 0 then 'Directory page' else 'Insufficient program facts' end as reason from documents where doc_id % 3 = 0",
    "catalog_field_history": """select (l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey as id, 'o' || cast(l_partkey as string) as opportunity_id, case (l_linenumber + l_suppkey) % 3 when 0 then 'status' when 1 then 'deadline' else 'maximum' end as field,
        case when l_quantity < 10 then null else 'v' || cast(l_orderkey % 3 as string) end as old_value, 'v' || cast(l_suppkey % 3 as string) as new_value, cast(l_shipdate as timestamp) as created_at, case when l_returnflag = 'A' then 'automatic' else 'editor' end as action from lineitem""",
    "catalog_fields": "select 'o' || cast(p_partkey as string) as opportunity_id, f.field, 'v' || cast(p_size % 3 as string) as value, (p_partkey + f.n) % 29 = 0 as locked, case when (p_partkey + f.n) % 31 = 0 then 'locked_conflict' else 'known' end as state from part join (values (0, 'status'), (1, 'deadline'), (2, 'maximum')) as f(n, field) on true",
    "search_jobs": f"""select o_orderkey as id, case when o_orderstatus = 'F' then 'complete' when o_orderstatus = 'P' then 'partial' when o_orderkey % 2 = 0 then 'running' else 'queued' end as status,
        {_NOW} - (o_orderkey % 72) * interval '1' hour as created_at, {_NOW} - (o_orderkey % 48) * interval '1' hour as finished_at, {_NOW} - (o_orderkey % 90 + 1) * interval '1' minute as last_served_at from orders""",
    "research_ledger": "select event_id as id, 'topic' || cast(user_id % 50 as string) as topic_key, cast(ts as timestamp) as created_at, case event_type when 'error' then 'failed' else 'complete' end as status, 10 as reserved_cents, event_id % 7 as queued_count, event_id % 2 as domain_count from events",
    "reconcile_items": f"""select date_trunc('day', cast(ts as timestamp)) as run_id, event_id as id, case event_type when 'error' then 'blocked' when 'signup' then 'ambiguous' when 'click' then 'queued' else 'complete' end as status,
        case when event_id % 5 = 0 then 'Continued in newer inventory' else '' end as reason, {_NOW} + (event_id % 9 - 4) * interval '1' hour as next_attempt_at from events where extract(day from ts) % 3 <> 0 or event_type <> 'click'""",
    "reconcile_events": "select date_trunc('day', cast(ts as timestamp)) as run_id, case event_type when 'purchase' then 'merged' when 'error' then 'hidden' else 'facts-resolved' end as action, case when event_id % 4 = 0 then 'none' else cast(event_id % 6 as string) end as detail from events",
    "contributions": f"""select o_orderkey as id, case o_orderkey % 4 when 0 then 'program' when 1 then 'deadline' when 2 then 'maximum' else 'secret' end as field, case when o_orderkey % 4 = 0 and o_orderkey % 8 <> 0 then '' else case when o_orderkey % 5 = 0 then '' else 'o' || cast(o_custkey as string) end end as opportunity_id,
        case when o_orderkey % 7 = 0 then '  ' else 'Change ' || o_orderpriority end as proposed, case when o_orderkey % 6 = 0 then 'decision' else 'new' end as state, cast(o_orderdate as timestamp) as created_at from orders""",
    "contribution_submissions": "select l_orderkey as contribution_id, l_linenumber as n, 'value ' || cast(l_suppkey as string) as proposed, l_linestatus as note from lineitem",
    "reviews": """select 'r' || cast(p_partkey as string) as id, case when p_partkey % 9 = 0 then 'ab' else p_name || ' ' || p_type || ' Grant' || case when p_partkey % 3 = 0 then '' else ' ' || cast(p_partkey as string) end end as name,
        'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(p_partkey * 2 as string) as url, case when p_partkey % 8 = 0 then 'short' else 'Funding for ' || p_name || ' projects' end as summary,
        case p_size % 3 when 0 then 'open' when 1 then 'upcoming' else 'closed' end as status, p_retailprice as minimum, case when p_partkey % 10 = 0 then p_retailprice - 1 else p_retailprice + 5 end as maximum,
        case when p_partkey % 4 <> 0 then date '2024-01-31' + cast(p_partkey % 61 - 30 as int) end as deadline, case when p_partkey % 3 <> 0 then date '2024-01-31' + cast(p_partkey % 41 - 20 as int) end as opens, case when p_partkey % 12 = 0 then 'usd' else 'USD' end as currency from part""",
    "page_links": """select doc_id as id, 'https://src' || cast(r % 20 as string) || '.example.org/programs/' || cast(r as string) as url, x.n, 'https://src' || cast(r % 20 as string) || '.example.org/programs/' || cast((doc_id + x.n * 20) % slots as string)
        || case (doc_id + x.n) % 6 when 0 then '/apply' when 1 then '/guidelines.pdf' when 2 then '/faq' when 3 then '/grant-news' else '' end as link from slots join (values (0), (1), (2), (5)) as x(n) on true""",
    "external_results": "select p_partkey as id, case p_partkey % 2 when 0 then 'federal' else 'state' end as provider, cast(p_partkey * 3 as string) as external_id, 'https://src' || cast(p_partkey % 20 as string) || '.example.org/' || case when p_partkey % 3 = 0 then 'programs/' else 'results/' end || cast(p_partkey as string) || case when p_partkey % 2 = 0 then '/' else '' end as source_url from part",
    "provider_records": "select case p_partkey % 2 when 0 then 'federal' else 'state' end as provider, cast(p_partkey as string) as external_id from part where p_partkey % 7 = 0",
    "raw_locations": """select c_custkey as id, case c_custkey % 6 when 0 then ' USA ' when 1 then 'U.S.' when 2 then 'united kingdom' when 3 then 'Global' when 4 then 'Canada' else '' end as country, case c_custkey % 3 when 0 then 'ny' when 1 then 'CALIFORNIA' else 'Ontario' end as state,
        case c_custkey % 4 when 0 then 'nyc' when 1 then ' New   York ' else 'Austin' end as city, case c_custkey % 5 when 0 then '10001-1234' when 1 then 'k1a 0b1' when 2 then '94110' else 'bad!' end as postal_code from customer""",
    "robots_rules": """select 'src' || cast(s_suppkey % 20 as string) || '.example.org' as host, s_suppkey as n, case s_suppkey % 3 when 0 then 'fundbot' else '*' end as agent, s_suppkey % 4 = 0 as allow,
        case s_suppkey % 5 when 0 then '/programs/' when 1 then '/programs/1*' when 2 then '/*faq$' when 3 then '/programs/2' else '/news' end as pattern from supplier""",
    "feed_federal_raw": """select p_partkey as n, '{"id":' || cast(p_partkey as string) || ',"opportunityTitle":"' || p_name || ' ' || p_type || ' Program","ost":"' || case p_partkey % 4 when 0 then 'POSTED' when 1 then 'FORECASTED' when 2 then 'CLOSED' else 'POSTED' end || '","synopsis":{"agencyName":"' || p_brand || '","fundingInstruments":[{"id":"' || case when p_partkey % 5 = 0 then 'L' else 'G' end
        || '"}],"applicantTypes":[{"id":"12"},{"id":"' || case when p_partkey % 2 = 0 then '21' else '23' end || '"}],"awardCeiling":"' || case when p_partkey % 6 = 0 then 'none' else cast(p_partkey * 10 as string) end || '","responseDateStr":"' || case p_partkey % 7 when 0 then '2024-02-30' when 1 then '2024-01-10-00-00' else '2024-05-01' end || '","postingDateStr":"' || case when p_partkey % 8 = 3 then '2024-03-01' else '2024-01-01' end || '"}}' as raw from part""",
    "feed_state_raw": """select p_partkey as n, '{"PortalID":' || cast(p_partkey as string) || ',"Title":"' || case when p_partkey % 11 = 0 then 'Short' else p_name || ' ' || p_type || ' Program' end || '","Type":"' || case when p_partkey % 5 = 0 then 'Loan' else ' Grant' end || '","Status":"' || case p_partkey % 3 when 0 then 'closed' when 1 then 'active' else 'forecasted' end || '","AgencyDept":"' || p_brand
        || '","ApplicantType":"Nonprofit; ' || case when p_partkey % 2 = 0 then 'Business' else 'Tribe' end || '","Geography":"' || case when p_partkey % 4 = 0 then 'Statewide.' else 'Coast only' end || '","EstAmounts":"' || case p_partkey % 3 when 0 then 'Between $500 and $1,000' when 1 then '$2,500' else 'Between $900 and $100' end || '","ApplicationDeadline":"' || case p_partkey % 4 when 0 then 'Ongoing' when 1 then '01/10/2024' else '2024-06-01' end || '"}' as raw from part""",
    "award_raw": """select p_partkey as n, '{"results":[{"appl_id":' || cast(p_partkey as string) || ',"opportunity_number":"PAR-' || cast(p_partkey % 40 as string) || '","project_title":"' || p_name || '","fiscal_year":2023},{"appl_id":' || cast(p_partkey + 1000000 as string) || ',"opportunity_number":"PAR-' || cast(p_partkey % 7 as string) || '","project_title":"' || p_type || '","fiscal_year":2022}]}' as raw from part""",
    "search_requests": "select conv_id, turn, text as q, c.name as category, case conv_id % 3 when 0 then 'United States' when 1 then 'Canada' end as country, case conv_id % 6 when 0 then 'New York' end as state, case conv_id % 4 when 0 then 'nonprofit' else '' end as applicant, case conv_id % 5 when 0 then 'open' else '' end as status, cast(conv_id % 2 * 500 as double) as min_award from conversations join category_names c on c.n = conv_id % 14 where role = 'user'",
    "raw_filters": """select o_orderkey as id, '  ' || o_orderpriority || ' ' || repeat('x', cast(o_orderkey % 3 * 110 as int)) as q, split(c.name || case when o_orderkey % 3 = 0 then ';Other;' else ';Music;' end || c.name, ';') as category, split(case when o_orderkey % 4 = 0 then 'rural' else 'moon' end || ';youth;youth', ';') as focus,
        case o_orderkey % 5 when 0 then 'nonprofit' when 1 then 'robot' when 2 then 'student' end as applicant, case when o_orderkey % 3 = 0 then 'nyc' else 'mars' end as location, case o_orderkey % 4 when 0 then 'open' when 1 then 'between_rounds' when 2 then '' else 'never' end as status, case when o_orderkey % 6 = 0 then 'new' else 'old' end as freshness,
        case o_orderkey % 3 when 0 then 'amount' when 1 then 'name' end as sort, case o_orderkey % 5 when 0 then 'leads' when 1 then 'all' when 2 then 'none' end as result_type, case o_orderkey % 7 when 0 then '-5' when 1 then ' 2500 ' when 2 then '1e12' when 3 then 'NaN' when 4 then '' when 5 then '12.5' end as min_award,
        case o_orderkey % 6 when 0 then '3' when 1 then '99999' when 2 then '0' when 3 then '2.5' when 4 then 'two' end as page, case when o_orderkey % 8 = 0 then '4' else '' end as program_page, case when o_orderkey % 9 = 0 then '5' else '' end as lead_page, case when o_orderkey % 10 = 0 then '6' end as candidate_page, case when o_orderkey % 4 = 1 then '1' else 'yes' end as saved
        from orders join category_names c on c.n = o_orderkey % 14""",
    "identity_urls": """select p_partkey as id, case p_partkey % 6 when 0 then 'https://www.nyfa.org/x/opportunity-info?a=1&id=' || cast(p_partkey as string) when 1 then 'https://www.grants.gov/search-results-detail/' || cast(p_partkey as string) || '/' when 2 then 'https://www.src' || cast(p_partkey % 20 as string) || '.example.org/'
        when 3 then 'https://grants.gov/search-results-detail/x' || cast(p_partkey as string) when 4 then 'https://nyfa.org/opportunity-info?b=' || cast(p_partkey as string) else 'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(p_partkey as string) || '/?a=1' end as url from part""",
    "phrases": "select c_custkey as id, t.phrase from customer join (values (0, 'the United States'), (1, 'ny'), (2, 'New York State'), (3, 'Worldwide'), (4, 'new york city'), (5, 'Georgia'), (6, 'Austin, TX'), (7, 'Austin, Texas, USA'), (8, 'Toronto, Ontario, Canada'), (9, 'Toronto, Canada'), (10, 'Canada and Mexico'), (11, 'Canada'), (12, 'UK'), (13, 'great britain'), (14, 'within Canada, Ontario, Canada'), (15, 'The Moon'), (16, 'a, b, c, Canada'), (17, ' california ')) as t(n, phrase) on t.n = c_custkey % 18",
    "scopes": """select c_custkey as id, t.scope, case c_nationkey % 5 when 2 then 'Canada' when 3 then '' else 'United States' end as country, case c_nationkey % 5 when 0 then 'New York' when 1 then 'California' when 2 then 'Ontario' else '' end as state, case c_nationkey % 5 when 0 then 'New York City' when 2 then 'Toronto' else '' end as city
        from customer join (values (0, 'United States'), (1, 'USA / New York'), (2, 'New York'), (3, 'New York City, New York'), (4, 'Worldwide'), (5, 'National'), (6, 'Canada | Ontario | Toronto'), (7, 'Toronto'), (8, 'Canada, France'), (9, 'Provider coverage; eligibility varies'), (10, 'Canada / Ontario'), (11, 'United States, New York City, Texas')) as t(n, scope) on t.n = c_custkey % 12""",
    "review_lines": r"""select p_partkey as id, case p_partkey % 6 when 0 then 'United States | New York | New York City
Worldwide' when 1 then ' Canada
' when 2 then 'Canada|Ontario

Mexico | | Oaxaca' when 3 then '' when 4 then '| Texas' else 'A|B|C|D' end as lines from part""",
    "lifecycle_pages": """select 'o' || cast(p_partkey as string) as id, dots || p_name || ' ' || p_type || ' Grant' as name, case when p_partkey % 5 = 0 then 'Other page' else 'About the ' || dots || p_name || '-' || p_type || ' grant' end as title,
        'Welcome to the page. ' || case p_partkey % 9 when 0 then 'This program has been permanently discontinued.' when 1 then 'The program is no longer offered this year.' when 2 then 'This fund may have been discontinued.' when 3 then dots || p_name || ' ' || p_type || ' Grant has reopened!' when 4 then 'This grant is now accepting applications if funds allow.' when 5 then 'We say that this grant is permanently closed.'
        when 6 then 'The program will no longer be offered after May. The program has resumed.' when 7 then dots || p_name || ' ' || p_type || ' grant has been discontinued' else 'Nothing new' end || ' ' || p_brand || ' was here.' as text from (select *, case when p_partkey % 4 = 0 then 'U.S. ' when p_partkey % 4 = 1 then 'St. ' else '' end as dots from part) as t""",
    "page_urls": f"""select doc_id as id, doc_id as snapshot_id, 'https://' || case when doc_id % 3 = 0 then 'www.' else '' end || 'src' || cast(r % 20 as string) || '.example.org/programs/' || cast(r as string) || case doc_id % 7 when 1 then '/apply' when 2 then '/docs/guidelines' when 3 then '/faq/' else '' end as url, {_NOW} - (doc_id % 100) * interval '1' day as fetched_at from slots""",
    "evidence_pages": f"""select 'o' || cast(r as string) as opportunity_id, 'https://src' || cast(r % 20 as string) || '.example.org/programs/' || cast(r as string) || case when doc_id % 2 = 0 then '/apply' else '/old' end as url, 'official-program-subpage' as association, doc_id as snapshot_id, {_NOW} - (doc_id % 50) * interval '1' day as fetched_at, doc_id % 3 as n_facts from slots where doc_id % 5 = 0""",
    "found_links": "select 'src' || cast(r % 20 as string) as source_id, case when doc_id % 11 = 0 then 'https://other' || cast(doc_id % 5 as string) || '.example.com/a' || cast(doc_id as string) else 'https://src' || cast(r % 20 as string) || '.example.org/programs/' || cast((doc_id * 7) % slots as string) end as link, cast(doc_id % 6 as int) as depth from slots",
    "crawl_frontier": "select 'src' || cast(p_partkey % 20 as string) as source_id, 'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(p_partkey as string) as url, cast(p_partkey % 4 as int) as depth from part",
    "publication_runs": f"select doc_id as candidate_id, case doc_id % 5 when 0 then 'failed' when 1 then 'skipped' else 'updated' end as outcome, 'v' || cast(12 + doc_id % 3 as string) as parser_version, {_NOW} - (doc_id % 37) * interval '1' day as processed_at, cast(doc_id % 7 as int) as attempts from documents where doc_id % 4 <> 0",
    "feed_records": """select case p_partkey % 2 when 0 then 'federal' else 'state' end as provider, cast(p_partkey as string) as external_id, 'https://src' || cast(p_partkey % 20 as string) || '.example.org/' || case when p_partkey % 3 = 0 then 'programs/' else 'feed/' end || cast(p_partkey as string) as url,
        p_name || ' ' || p_type || case when p_partkey % 7 = 0 then ' GRANT' else ' Feed Fund' end as title, case when p_partkey % 11 = 0 then null else 'Supplier#00000000' || cast(1 + p_partkey % 9 as string) end as funder, 'size ' || cast(p_size as string) as content from part""",
    "feed_known": "select provider, external_id, case when length(external_id) % 2 = 0 then 'o' || external_id end as opportunity_id, case when substr(content, 6, 1) in ('1', '3') then md5(title || '|' || coalesce(funder, '') || '|' || url || '|' || content) else 'old' end as hash from feed_records where provider = 'state'",
    "suggestions": "select 'https://src' || cast(l_suppkey % 20 as string) || '.example.org/programs/' || cast(l_partkey as string) as url, case when l_linenumber % 2 = 0 then 'o' || cast(l_partkey as string) end as opportunity_id, case when l_linenumber % 2 = 0 then 'deadline' else 'program' end as field, l_orderkey % 40 as user_id, l_comment as proposed from (select *, cast(l_quantity as string) as l_comment from lineitem)",
    "suggestions_old": "select p_partkey as id, 'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(p_partkey as string) as url, case when p_partkey % 2 = 0 then 'o' || cast(p_partkey as string) end as opportunity_id, case when p_partkey % 2 = 0 then 'deadline' else 'program' end as field, case p_partkey % 4 when 0 then 'checking' when 1 then 'decision' when 2 then 'unconfirmed' else 'applied' end as state from part",
    "field_evidence": "select 'o' || cast(p_partkey as string) as opportunity_id, 'deadline' as field, case p_partkey % 5 when 0 then 'conflicting' when 1 then 'not_checked' when 2 then 'locked_conflict' else 'found' end as state, 'https://src' || cast(p_partkey % 20 as string) || '.example.org/programs/' || cast(p_partkey - p_partkey % 3 as string) as evidence_url from part",
    "lead_reports": "select o_orderkey % 700 as run_id, 'w' || cast(o_custkey as string) as workspace_id, 'https://src' || cast(o_orderkey % 20 as string) || '.example.org/programs/' || cast(o_orderkey % 90 as string) as url, 'Lead ' || cast(o_orderkey as string) as title, case when o_orderkey % 700 % 3 = 0 then 1 else 0 end as warnings, cast(o_orderdate as timestamp) as seen_at from orders",
    "lead_store": "select 'w' || cast(c_custkey as string) as workspace_id, 'https://src' || cast(c_custkey % 20 as string) || '.example.org/programs/' || cast(c_custkey % 90 as string) as url, 'Old lead' as title, timestamp '1998-06-01 00:00:00' as seen_at from customer",
    "target_jobs": """select c_custkey as job_id, case c_custkey % 4 when 0 then 'grant' when 1 then 'women projects' when 2 then 'und for' else '' end as q, case when c_custkey % 11 <> 0 then n.name end as category, case c_custkey % 9 when 0 then 'women' when 4 then 'rural' end as focus_tag,
        case c_custkey % 3 when 0 then 'nonprofit' when 1 then 'individual' else case when c_custkey % 5 <> 1 then 'business' end end as applicant, cast(case c_custkey % 5 when 0 then 950 else 0 end as double) as min_award, case c_custkey % 7 when 0 then 'new' when 1 then 'updated' else '' end as freshness, case c_custkey % 8 when 3 then 'upcoming' end as status,
        case c_nationkey % 3 when 0 then 'United States' when 1 then 'Canada' end as country, case c_nationkey % 3 when 0 then 'New York' end as state from customer join category_names n on n.n = c_custkey % 14""",
    "search_intents": "select c_custkey as job_id, case c_custkey % 4 when 0 then 'grant' when 1 then 'women' else '' end as q, n.name as category, case c_nationkey % 3 when 0 then 'United States' when 1 then 'Canada' end as country, case c_nationkey % 3 when 0 then 'New York' end as state from customer join category_names n on n.n = c_custkey % 14",
    "program_origins": f"""select 'o' || cast(p_partkey as string) as id, case p_partkey % 3 when 0 then 'editor' else 'crawler' end as publication_origin, case p_partkey % 5 when 0 then 'editor' when 1 then 'official' when 2 then 'source' end as category_origin,
        case when p_partkey % 4 = 0 then {_NOW} - (p_partkey % 5) * interval '6' hour end as source_fetched_at, case when p_partkey % 6 = 1 then {_NOW} - (p_partkey % 7) * interval '5' hour end as last_verified_at from part""",
    "worker_samples": "select event_id as id, cast(ts as timestamp) as started, cast(ts as timestamp) + (event_id % 150) * interval '1' minute as finished from events where event_type = 'signup'",
    "worker_checks": "select user_id, cast(ts as timestamp) as at, 'https://src' || cast(user_id % 20 as string) || '.example.org/programs/' || cast(user_id as string) as url from events",
    "fact_pages": """select page_id, case page_id % 4 when 0 then 'https://www.spencer.org/grant_types/p' else 'https://pages.example.org/p' end || cast(page_id as string) as url,
        '<main><h1>Program ' || cast(page_id as string) || '</h1><p>A short note on a grant.</p>' || case page_id % 3 when 0 then '' else '<p>This ' || case page_id % 3 when 1 then 'grant' else 'fellowship' end || ' number ' || cast(page_id as string) || ' supports projects that bring many neighbours together.</p>' end
        || case page_id % 5 when 0 then '' when 1 then '<h2>Eligibility</h2><p>Nobody.</p>' else '<h2>Eligibility</h2><p>Residents of county ' || cast(page_id as string) || ' aged eighteen or more may apply.</p>' end || case page_id % 10 when 3 then '<h3>Who can apply?</h3><p>Groups of five people or more who live near each other.</p>' else '' end
        || '<h2>Dates</h2><p>' || case page_id % 7 when 0 then 'Deadline: 2024-05-' || cast(10 + page_id % 25 as string) || '.' when 1 then 'Applications due: 6/' || cast(1 + page_id % 28 as string) || '/2024.' when 2 then 'Deadline: 2024-05-01. Deadline: 2024-06-01.' when 3 then 'Deadline: March 3, 2024.' when 4 then 'Application Deadline: June 31, 2024.' else '' end
        || case page_id % 6 when 0 then ' Budgets up to $' || cast(1 + page_id % 90 as string) || ',000.' when 1 then ' Budgets up to $5,000 and budgets up to $6,000.' else '' end || case page_id % 8 when 0 then ' Applications are open.' when 4 then ' Applications are closed.' else '' end || '</p></main>' || coalesce(html, '') as html from pages""",
    "claimed_facts": """select doc_id as id, case doc_id % 2 when 0 then 'https://www.spencer.org/grant_types/p' else 'https://pages.example.org/p' end || cast(doc_id as string) as url,
        coalesce(text, '') || ' This  grant supports' || chr(10) || ' community research.   Teachers at any school' || chr(9) || 'may apply. ' || case when doc_id % 6 = 0 then '' else 'Budgets up to $50,000. ' end || 'Deadline: 2024-05-01. Applications are open.' as body,
        case when doc_id % 5 = 0 then 'An invented summary that no page holds.' else 'This grant supports community research.' end as summary, case when doc_id % 7 = 0 then null else 'Teachers at any school may apply.' end as eligibility,
        case doc_id % 4 when 3 then 'paused' else 'open' end as status, 'Applications are open.' as status_evidence, case when doc_id % 10 = 8 then '500000000' else '50000' end as maximum, 'USD' as currency, 'Budgets up to $50,000' as amount_evidence,
        case when doc_id % 12 = 4 then '2024-05-32' else '2024-05-01' end as deadline, 'Deadline: 2024-05-01' as deadline_evidence, case doc_id % 2 when 0 then 'spencer-program-v1' end as official_adapter from documents""",
    "example_pages": """select page_id, 'https://pages.example.org/harbor/' || cast(page_id as string) as url, '<main><h1>Harbor ' || cast(page_id as string) || ' Arts Grant</h1><article><h3>Tidal Songs ' || cast(page_id as string) || '</h3><a href="/projects/' || cast(page_id as string) || '">Tidal Songs</a><p>'
        || case page_id % 4 when 0 then 'This was not funded by the Harbor ' else 'A recipient of the Harbor ' end || cast(page_id + page_id % 3 as string) || ' Arts Grant in ' || case page_id % 5 when 0 then 'spring' else cast(2010 + page_id % 14 as string) end || ' that sang on all of the seven bridges of the town until the last of the boats had come home that night.</p></article>'
        || '<article><h3>A form</h3><a href="/forms/' || cast(page_id as string) || '">' || case page_id % 3 when 0 then 'Blank template' when 1 then 'View all recipients' else 'Narrative' end || '</a><p>A sample application for the Harbor ' || cast(page_id as string) || ' Arts Grant.</p></article></main>' || coalesce(html, '') as html from pages""",
    "example_programs": "select 'p' || cast(page_id as string) as id, 'Harbor ' || cast(page_id as string) || ' Arts Grant' as name, 'https://pages.example.org/harbor/' || cast(page_id as string) as source_url from pages",
    "example_primary": "select page_id, 'p' || cast(page_id as string) as id from pages where page_id % 2 = 0",
    "draft_sources": "select 'https://pages.example.org/d' || cast(doc_id as string) as url, coalesce(text, '') || ' Submit the  form by May 3rd, 2024 or by 06/14/2024. Attach a budget.' as text from documents",
    "draft_tasks": """select doc_id as draft_id, x.n, 'Task ' || cast(x.n as string) as title, '' as notes, case (doc_id + x.n) % 4 when 0 then '2024-05-03' when 1 then '2024-06-14' when 2 then '2024-05-04' end as due_date,
        'https://pages.example.org/d' || cast(case when doc_id % 17 = 0 then -1 else doc_id end as string) as source_url, case when doc_id % 5 = 0 and x.n = 1 then 'An invented requirement' when x.n = 2 then 'Attach a  budget.' else 'Submit the form' || chr(10) || 'by May' end as source_excerpt,
        case when x.n = 2 then 'Which budget?' else '' end as uncertainty, case when doc_id % 3 = 0 then '' when x.n = 1 then 'by 06/14/2024' else 'by May 3rd, 2024' end as date_excerpt from documents cross join (values (0), (1), (2)) as x(n) where doc_id % 11 <> 0 or x.n = 0""",
    "catalog_reviews": f"""select 'v' || cast(p_partkey as string) as review_id, case when p_partkey % 11 = 0 then '' when p_partkey % 13 = 0 then 'nobody' when p_partkey % 5 = 0 then 'o' || cast(p_partkey - 1 as string) else 'o' || cast(p_partkey as string) end as id,
        case when p_partkey % 7 = 0 then timestamp '2020-01-01 00:00:00' when p_partkey % 3 = 0 then null else {_NOW} - (case when p_partkey % 5 = 0 and p_partkey % 11 <> 0 then p_partkey - 1 else p_partkey end % 12) * interval '1' day end as base_version,
        case when p_partkey % 23 = 0 then 'ab' when p_partkey % 17 = 0 then 'Reviewed program ' || cast(p_partkey - 1 as string) else 'Reviewed program ' || cast(p_partkey as string) end as name, case p_partkey % 4 when 0 then 'supplier#000000001' when 1 then 'New Funder ' || cast(p_partkey % 9 as string) else 'NEW funder ' || cast(p_partkey % 9 as string) end as funder,
        case when p_partkey % 19 = 0 then 'https://src' || cast((p_partkey + 1) % 20 as string) || '.example.org/programs/' || cast(p_partkey + 1 as string) else 'https://reviewed.example.org/' || cast(p_partkey as string) end as url, 'A reviewed summary of ' || p_name || ' projects.' as summary, 'Applicants in ' || p_brand || ' may apply.' as eligibility, 'Checked on the official page.' as notes, 'The official page states every value that is given here.' as evidence,
        case p_size % 3 when 0 then 'open' when 1 then 'closed' else 'unknown' end as status, p_retailprice as minimum, p_retailprice + 5 as maximum, case when p_partkey % 4 <> 0 then date '2024-01-31' + cast(p_partkey % 61 - 10 as int) end as deadline, cast(null as date) as opens, p_partkey % 6 = 0 as rolling, cast(null as double) as fee, 'USD' as currency,
        c.name as category, a.name as applicant, case p_partkey % 3 when 0 then 'Worldwide' when 1 then 'United States | New York' || chr(10) || 'Canada' else 'Canada | Ontario | Toronto' end as locations, p_partkey % 9 = 0 as archive, {_NOW} - (p_partkey % 50) * interval '1' minute as reviewed_at
        from part join category_names c on c.n = p_partkey % 14 join applicant_names a on a.n = p_partkey % 9""",
    "reconcile_pages": f"""select 'p' || cast(p_partkey as string) as item_id, p_partkey as ord, 'o' || cast(p_partkey as string) as opportunity_id, cast(null as bigint) as candidate_id, o.source_url as item_url, case when p_partkey % 37 = 0 then 'https://moved.example.org/x' else o.source_url || case when p_partkey % 12 = 5 then '/faq' else '' end end as page_url,
        case p_partkey % 6 when 0 then 'Grants' when 1 then 'Grant guidelines' else o.name end as title, 'Apply for funding. This grant supports projects and provides awards to applicants.' as body from part join opportunities o on o.k = p_partkey where not o.is_demo and o.publication_state = 'published' and o.merged_into is null
        union all select 'c' || cast(id as string), 1000000000 + id, opportunity_id, id, url, url, case when id % 5 = 2 then 'Rural Arts Fund' else title end, 'Apply for funding. This grant supports projects and provides awards to applicants.' from crawl_candidates where status = 'pending' and kind <> 'domain'""",
    "search_raw": """select p_partkey % 50 as run_id, p_partkey as n, '{"results":[{"url":"https://a' || cast(p_partkey % 9 as string) || '.example.org/x/","title":" The <b>' || p_name || '</b> fund "},{"url":"http://plain.example.org","title":"no"},{"url":"https://b.example.org/' || cast(p_partkey % 40 as string) || '#top","title":"' || p_type || '"}]}' as raw from part""",
    "cited_raw": """select p_partkey as id, '{"output":[{"type":"message","content":[{"type":"text","annotations":[{"type":"url_citation","url":"https://a.example.org/' || cast(p_partkey % 7 as string) || '/"},{"type":"url_citation","url":"https://a.example.org/' || cast(p_partkey % 3 as string) || '"},{"type":"file","url":"https://c.example.org/"},{"type":"url_citation","url":"https://d.example.org/?Token=1"},{"type":"url_citation","url":"http://e.example.org/"}]}]},{"type":"reasoning","content":[{"type":"text","annotations":[{"type":"url_citation","url":"https://f.example.org/"}]}]}]}' as raw from part""",
    "ledger_requests": "select event_id as id, user_id % 7 as ledger, 'topic' || cast(user_id % 50 as string) as topic_key, cast(ts as timestamp) as ts from events",
    "snapshot_refs": "select snapshot_id from crawl_candidates union all select snapshot_id from evidence_pages union all select -1 - doc_id from documents where doc_id % 16 = 1 union all select -1 - doc_id from documents where doc_id % 24 = 9",
    "date_texts": "select o_orderkey as id, case o_orderkey % 7 when 0 then cast(cast(o_orderdate as date) as string) when 1 then ' ' || cast(cast(o_orderdate as date) as string) || ' 00:00' when 2 then cast(extract(month from o_orderdate) as string) || '/' || cast(extract(day from o_orderdate) as string) || '/1999' when 3 then '2024-02-30' when 4 then 'Ongoing' when 5 then '13/1/2024' end as raw from orders",
    "feed_progress": "select o_orderkey as session_id, case o_orderkey % 2 when 0 then 'federal' else 'state' end as provider, cast(o_orderkey % 3 as int) as phase, cast(o_orderkey % 90 as int) as cursor, cast(o_orderkey % 4 as int) as staged, cast(o_orderkey % 70 as int) as total from orders",
    "feed_session_results": "select l_orderkey as session_id, l_partkey as result_id from lineitem where l_returnflag = 'R'",
    "source_registry": "select id, 'Source ' || id || case s.n % 3 when 0 then ' of music' when 1 then ' for artist and research' else '' end as name, url, a.name as c1, b.name as c2, case s.n % 12 when 0 then 'United States' when 1 then 'USA / New York' when 2 then 'New York' when 3 then 'Worldwide' when 4 then 'National' when 5 then 'Canada / Ontario' when 6 then 'California' when 7 then 'New York City, New York' else 'United States' end as scope from (select *, cast(substr(id, 4) as bigint) as n from crawl_sources) as s join category_names a on a.n = s.n % 14 join category_names b on b.n = (s.n + 5) % 14",
}


def needed(sql: str) -> list[str]:
    """Views that a text names, and those they name, in the order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop())) & VIEWS.keys() - found
        found |= words
        todo += [VIEWS[w] for w in words]
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """An oracle's text with the views it needs before it."""
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in needed(sql))
    return f"with {views} {sql}" if views else sql


class Catalog:
    """The catalog's DataFrames by name, over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        # Spark takes a file's compressed size for its rows' size, and files of rows that are
        # much alike are fifty times smaller: whole tables would be broadcast by the driver.
        # With this factor only small tables are planned so, others by what a shuffle counts.
        if float(spark.conf.get(FACTOR)) < COMPRESSED:
            spark.conf.set(FACTOR, str(COMPRESSED))

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = with_views(VIEWS[name])
        # Under names of their own, so that no view of the session is replaced.
        base = re.compile(rf"\b(from|join) ({'|'.join(BASE)})\b")
        for table in {m[1] for m in base.findall(text)}:
            self[table].createOrReplaceTempView(f"fundcat_{table}")
        return self.spark.sql(base.sub(r"\1 fundcat_\2", text))
