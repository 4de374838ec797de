"""Registered queries of facts, examples, drafts, reviews and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.operators import editorial as D
from fundcat.operators import page_facts as G
from fundcat.operators import reconcile as R
from fundcat.plans.base import NOW, TODAY, query
from fundcat.schema import AS_OF
from fundcat.sources.outline import outlines
from fundcat.tables import kept

_DUE = "(?i)(?:application deadline|applications due|deadline)\\s*:\\s*"
_NUMERIC = f"{_DUE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})\\b"
_NAMED = f"{_DUE}(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+[0-9]{{1,2}},?\\s+[0-9]{{4}}\\b"


@query(
    "html_facts",
    f"""with m as (select page_id, url, starts_with(url, 'https://www.spencer.org/grant_types/') as ours, regexp_extract(html, '^<main>(.*?)</main>', 1, 's') as b from fact_pages), t as (select *, trim(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from m),
 x as (select *, list_filter(regexp_extract_all(b, '<p>([^<]*)</p>', 1), lambda p: length(p) between 60 and 1500 and regexp_matches(p, '(?i)\\b(grant|funding|fellowship|award)s?\\b'))[1] as summary, list_filter(regexp_extract_all(b, '<h[23]>(?:Eligibility|Who can apply\\?)</h[23]><p>([^<]*)</p>', 1), lambda p: length(p) between 40 and 5000) as who,
  regexp_extract_all(text, '{_NUMERIC}') as nums, regexp_extract_all(text, '{_NAMED}') as names, list_distinct(regexp_extract_all(text, '(?i)budgets up to \\$([0-9,]+)', 1)) as sums, regexp_matches(text, 'Applications are closed') as shut, regexp_matches(text, 'Applications are open') as free from t),
 d as (select *, case when ours and len(names) > 0 then case when len(names) = 1 and len(nums) = 0 then names[1] end when len(nums) = 1 then nums[1] end as said from x),
 v as (select *, strftime(coalesce(try_strptime(regexp_extract(said, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '%Y-%m-%d'), try_strptime(regexp_extract(said, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}'), '%-m/%-d/%Y'), try_strptime(regexp_extract(said, '[A-Z][a-z]+ [0-9]{{1,2}}, [0-9]{{4}}$'), '%B %-d, %Y')), '%Y-%m-%d') as due from d)
 select page_id, summary, case when len(who) = 1 then who[1] end as eligibility, due as deadline, case when due is not null then said end as deadline_evidence, case when ours and len(sums) = 1 then replace(sums[1], ',', '') end as maximum, case when ours and shut then 'closed' when ours and free then 'open' end as status, case when ours then 'spencer-program-v1' end as official_adapter from v""",
)
def html_facts(c):
    return G.html_facts(outlines(c["fact_pages"])).select("page_id", "summary", "eligibility", "deadline", "deadline_evidence", "maximum", "status", "official_adapter")


_SPAN = "case when regexp_matches(body, '{0}') then [{1}length(regexp_extract(body, '(?s)^(.*?){0}', 1)), length(regexp_extract(body, '(?s)^(.*?{0})', 1))] end"
_CLAIMS = (("summary", "This\\s+grant\\s+supports\\s+community\\s+research\\."), ("eligibility", "Teachers\\s+at\\s+any\\s+school\\s+may\\s+apply\\."), ("status", "Applications\\s+are\\s+open\\."), ("maximum", "Budgets\\s+up\\s+to\\s+\\$50,000"), ("deadline", "Deadline:\\s+2024-05-01"))


@query(
    "evidence_check",
    f"""with s as (select *, {", ".join(f"{_SPAN.format(p, '')} as at_{f}" for f, p in _CLAIMS)} from claimed_facts),
 v as (select id, url, official_adapter, case when summary not like 'An invented%' then summary end as summary, eligibility, case when status = 'open' then status else 'unknown' end as status, case when at_maximum is not null and maximum = '50000' then 50000.00 end as maximum, case when deadline = '2024-05-01' then deadline end as deadline, at_summary, at_eligibility, at_status, at_maximum, at_deadline from s)
 select id, summary, eligibility, status, cast(maximum as varchar) as maximum, deadline, official_adapter is not null and summary is not null and eligibility is not null and maximum is not null and deadline is not null and status <> 'unknown' as auto_verified,
 array_to_string(list_filter([{", ".join(f"case when {f} is not null and {f} <> 'unknown' then '{f} ' || at_{f}[1] || '-' || at_{f}[2] end" for f in ("summary", "eligibility", "status"))}, case when maximum is not null then 'maximum ' || at_maximum[1] || '-' || at_maximum[2] end, case when deadline is not null then 'deadline ' || at_deadline[1] || '-' || at_deadline[2] end], lambda x: x is not null), '; ') as spans from v""",
)
def evidence_check(c):
    rows = G.evidence_check(c["claimed_facts"], AS_OF)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["field"], F.lit(" "), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), "; ")
    return rows.select("id", "summary", "eligibility", "status", F.col("maximum").cast("decimal(7,2)").cast("string").alias("maximum"), F.col("deadline").cast("string").alias("deadline"), "auto_verified", spans.alias("spans"))


_CARDS = """m as (select page_id, url, unnest(regexp_extract_all(regexp_extract(html, '^<main>(.*?)</main>', 1, 's'), '<article>.*?</article>')) as b, generate_subscripts(regexp_extract_all(regexp_extract(html, '^<main>(.*?)</main>', 1, 's'), '<article>.*?</article>'), 1) - 1 as place from example_pages),
 k as (select page_id, url as page_url, place, regexp_extract(b, '<h3>([^<]*)', 1) as head, regexp_extract(b, '<a [^>]*>([^<]*)', 1) as label, 'https://pages.example.org' || regexp_extract(b, 'href="([^"]*)"', 1) as url, trim(regexp_replace(regexp_replace(b, '<(/?)(h3|p|article)>|</?a[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as loose, b from m),
 t as (select *, case when label = 'View all recipients' then head else label end as title, regexp_extract(b, '<h3>([^<]*)', 1) || ' ' || regexp_extract(b, '<a [^>]*>([^<]*)', 1) || regexp_extract(b, '<p>([^<]*)', 1) as context from k),
 e as (select page_id, page_url, place, case when regexp_matches(title || ' ' || context, '(?i)\\bsample application') then 'sample_application' when regexp_matches(context, '(?i)\\brecipients?\\b') then 'funded_project' when regexp_matches(context, '(?i)\\bfunded by\\b') then 'funded_project' end as kind, title, url, array_to_string(string_split(context, ' ')[1:22], ' ') as excerpt, nullif(regexp_extract(context, '\\b(?:19|20)[0-9]{2}\\b'), '') as year, context from t where not regexp_matches(context, '(?i)not funded') and title <> 'Blank template'),
 ex as (select * from e where kind is not null and length(title) >= 5)"""


def _examples(c):
    return G.example_extract(outlines(c["example_pages"]))


@query("example_extract", f"with {_CARDS} select page_id, place, kind, title, url, excerpt, year from ex")
def example_extract(c):
    return _examples(c).where("not own").select("page_id", F.col("place").cast("long").alias("place"), "kind", "title", "url", "excerpt", "year")


@query(
    "example_attach",
    f"""with {_CARDS}, pairs as (select ex.*, p.id, p.source_url, lower(p.name) as low from ex join example_programs p on exists (select 1 from example_primary q where q.page_id = ex.page_id and q.id = p.id) or contains(lower(ex.context), lower(p.name)))
 select id, page_id, row_number() over (partition by id, page_id order by place) as n, url, kind, title from pairs where url <> source_url and lower(title) <> low""",
)
def example_attach(c):
    examples = kept(_examples(c).where("not own"), "examples")
    return G.example_attach(examples, c["example_programs"], c["example_primary"]).select("id", "page_id", F.col("n").cast("long").alias("n"), "url", "kind", "title")


@query(
    "draft_validate",
    """with f as (select t.*, trim(regexp_replace(s.text, '\\s+', ' ', 'g')) as src, trim(regexp_replace(source_excerpt, '\\s+', ' ', 'g')) as ex from draft_tasks t left join draft_sources s on s.url = t.source_url),
 g as (select *, coalesce(contains(src, ex), false) as grounded, date_excerpt <> '' and coalesce(contains(src, date_excerpt), false) and coalesce(case due_date when '2024-05-03' then contains(date_excerpt, 'May 3rd, 2024') when '2024-06-14' then contains(date_excerpt, '06/14/2024') else false end, false) as dated from f),
 d as (select draft_id, bool_and(grounded) as ok from g group by 1)
 select 'draft' as tab, cast(draft_id as varchar) as k, case when ok then 'kept' else 'rejected' end as v, case when not ok then 'unsupported task' end as note from d
 union all select 'task', draft_id || '-' || n, case when dated then due_date end, case when due_date is null or dated then uncertainty else ltrim(uncertainty || ' No supported due date was found; choose a date if needed.') end from g join d using (draft_id) where ok""",
)
def draft_validate(c):
    drafts, tasks = D.draft_validate(c["draft_tasks"], c["draft_sources"])
    left = drafts.select(F.lit("draft").alias("tab"), F.col("draft_id").cast("string").alias("k"), F.col("outcome").alias("v"), F.col("reason").alias("note"))
    return left.union(tasks.select(F.lit("task"), F.concat_ws("-", "draft_id", "n"), "due_date", "uncertainty"))


_BARE = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_REVIEWED = f"""r0 as (select *, id = '' as is_new, case when id = '' then 'review-' || md5(url) else id end as program, {_BARE.format('name')} as bare, name = 'ab' or (status = 'open' and coalesce(deadline < {TODAY}, false)) as broken from catalog_reviews),
 r1 as (select r0.*, o.id is not null as there, o.catalog_updated_at as version from r0 left join opportunities o on o.id = r0.program), r2 as (select *, case when broken then 'rejected' when not is_new and not there then 'not found' when is_new and there or exists (select 1 from opportunities o where o.id <> program and ({_BARE.format('o.name')} = bare or o.source_url = r1.url)) then 'duplicate' when not is_new and base_version is not null and base_version <> version then 'stale' end as o1 from r1),
 r3 as (select *, row_number() over (partition by program, o1 is null order by reviewed_at, review_id) as turn from r2), lead as (select *, rank() over (partition by bare order by reviewed_at, review_id) as named from r3 where o1 is null and turn = 1),
 rv as (select r3.*, coalesce(r3.o1, case when r3.turn > 1 then case when r3.is_new then 'duplicate' else 'stale' end when lead.named > 1 then 'duplicate' else 'applied' end) as outcome from r3 left join lead on lead.review_id = r3.review_id),
 yes as (select rv.*, coalesce((select min(f.id) from funders f where lower(f.name) = lower(rv.funder)), 'f-' || md5(lower(rv.funder))) as funder_id from rv where outcome = 'applied')"""


@query(
    "review_apply",
    f"""with {_REVIEWED} select 'review' as tab, review_id as k, outcome as v from rv
 union all select 'program', o.id, coalesce(y.name, o.name) || ' / ' || coalesce(y.funder_id, o.funder_id) || ' / ' || case when y.program is null then o.application_status else y.status end || ' / ' || coalesce(cast(case when y.program is null then o.deadline else y.deadline end as varchar), '') || ' / ' || case when y.program is null then o.publication_state when y.archive then 'hidden' else 'published' end from opportunities o left join yes y on y.program = o.id and not y.is_new
 union all select 'program', program, name || ' / ' || funder_id || ' / ' || status || ' / ' || coalesce(cast(deadline as varchar), '') || ' / ' || case when archive then 'hidden' else 'published' end from yes where is_new
 union all select 'funder', id, name from funders union all select 'funder', funder_id, min(funder) from yes where funder_id like 'f-%' group by 2
 union all select 'category', opportunity_id, category from opportunity_categories where opportunity_id not in (select program from yes) union all select 'category', program, category from yes
 union all select 'place', opportunity_id, concat_ws('|', country, state, city) from opportunity_geographies where opportunity_id not in (select program from yes)
 union all select 'place', program, unnest(case locations when 'Worldwide' then [''] else list_transform(string_split(locations, chr(10)), lambda x: replace(x, ' | ', '|')) end) from yes
 union all select 'monitor', m.opportunity_id, case when m.state = 'discontinued' and y.program is not null and not y.archive then 'active' else m.state end from catalog_monitoring m left join yes y on y.program = m.opportunity_id""",
)
def review_apply(c):
    reviews = c["catalog_reviews"].withColumns({"categories": F.array("category"), "applicants": F.array("applicant")})
    tables = {
        "opportunities": c["opportunities"], "funders": c["funders"], "categories": c["opportunity_categories"], "applicants": c["opportunity_applicant_types"], "geographies": c["opportunity_geographies"],
        "monitoring": c["catalog_monitoring"], "applied": reviews.select("review_id").where("false"),
    }
    out = D.review_apply(reviews, tables, AS_OF)
    program = F.concat_ws(" / ", "name", "funder_id", "application_status", F.coalesce(F.col("deadline").cast("string"), F.lit("")), "publication_state")
    rows = out["outcomes"].select(F.lit("review").alias("tab"), F.col("review_id").alias("k"), F.col("outcome").alias("v"))
    for tab, table, k, v in (("program", "opportunities", "id", program), ("funder", "funders", "id", F.col("name")), ("category", "categories", "opportunity_id", F.col("category")), ("place", "geographies", "opportunity_id", F.concat_ws("|", "country", "state", "city")), ("monitor", "monitoring", "opportunity_id", F.col("state"))):
        rows = rows.union(out[table].select(F.lit(tab), k, v))
    return rows


@query("reconcile_decide")
def reconcile_decide(c):
    day = c["crawl_snapshots"].where(f"fetched_at > {NOW} - interval '24' hour").select(F.col("url").alias("source_url"), F.lit(True).alias("fresh")).distinct()
    programs = c["opportunities"].where("not is_demo and merged_into is null").join(day, "source_url", "left").select("id", "name", "source_url", (F.col("verification_status") == "verified").alias("verified"), "created_at", F.lit("crawler").alias("origin"), F.lit(None).cast("string").alias("method"), "publication_state", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return R.reconcile_decide(c["reconcile_pages"], programs, c["opportunity_source_urls"], AS_OF)
