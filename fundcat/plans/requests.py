"""Registered queries of search requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.operators import requests as R
from fundcat.plans.base import query
from fundcat.schema import APPLICANT_TYPES, CATEGORIES, FOCUS, STATUSES


def one_of(col: str, options, default: str = "") -> str:
    return f"case when {col} in ({', '.join(repr(o) for o in options)}) then {col} else '{default}' end"


def known(col: str, options) -> str:
    return f"coalesce(list_filter({col}, lambda x: x in ({', '.join(repr(o) for o in options)})), [])"


def number(col: str) -> str:
    return f"(case when regexp_matches(trim({col}), '{R.NUMBER}') then try_cast(trim({col}) as double) end)"


def page(col: str) -> str:
    n = number(col)
    return f"cast(case when {n} > 0 and {n} = floor({n}) then least({n}, {R.LAST_PAGE}) else 1 end as int)"


@query(
    "filter_parse",
    f"""with r as (select *, {one_of('result_type', R.RESULT_TYPES, 'programs')} as kind, {known('category', CATEGORIES)} as cats, {known('focus', FOCUS)} as tags from raw_filters),
 p as (select *, coalesce(nullif(program_page, ''), case when kind <> 'leads' then nullif(page, '') end) as pp, coalesce(nullif(lead_page, ''), nullif(candidate_page, ''), case when kind = 'leads' then nullif(page, '') end) as lp from r)
 select id, substr(trim(coalesce(q, '')), 1, {R.LONGEST_Q}) as q, array_to_string(list_sort(list_distinct(cats)), '|') as categories, coalesce(cats[1], '') as category, array_to_string(list_sort(list_distinct(tags)), '|') as focus,
 {one_of('applicant', APPLICANT_TYPES)} as applicant, {one_of('location', R.LOCATIONS)} as location, {one_of('status', STATUSES)} as status, {one_of('freshness', R.FRESHNESS)} as freshness, {one_of('sort', R.SORTS, 'recommended')} as sort, kind as result_type,
 case when {number('min_award')} >= 0 then least({number('min_award')}, {R.MOST_MONEY}) else 0.0 end as min_award, {page('pp')} as program_page, {page('lp')} as lead_page, case when kind = 'leads' then {page('lp')} else {page('pp')} end as page, coalesce(saved = '1', false) as saved from p""",
)
def filter_parse(c):
    joined = lambda col: F.array_join(F.array_sort(col), "|")
    return R.filter_parse(c["raw_filters"]).withColumns({"categories": joined("categories"), "focus": joined("focus")})
