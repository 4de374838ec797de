"""What a page is to a program: an ordered table of rules over title, path and body."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundcat.functions import exprs as X

#: Fixed values, first match wins: the role, what is looked at (``title``, ``path``, or
#: ``words`` for title and path together) and the pattern, in any case.
ROLE_RULES: tuple[tuple[str, str, str], ...] = (
    ("directory", "title", r"\b(grants?[- ]recap|grant archives|grant program contacts|solicitations? & awards)\b"),
    ("directory", "title", r"^(?:grants? & scholarships|solicitations|the grants(?:\s*[—–|].*)?)$"),
    ("supporting", "title", r"\b(questionnaires?|office hours?)\b"),
    ("supporting", "title", r"^manag(?:e|ing) (?:your |a )?.*grants?\b"),
    ("supporting", "path", r"/manage-a-grant(?:/|$)"),
    ("directory", "title", r"^(?:top |best )?\d+\s+(?:(?:terrific|best|great|top|available|small business)\s+)*(?:grants|funding opportunities)\b"),
    ("directory", "title", r"\b(article|news roundup|grant roundup|funding roundup)\b"),
    ("directory", "title", r"^(?:\d+ |top \d+ |best )(?:grants|funding opportunities) for\b"),
    ("supporting", "title", r"^(?:anatomy of|a guide to|guide to|tips for|advice for|how to)\b"),
    ("supporting", "title", r"[?？]$"),
    ("supporting", "title", r"^(who|what|when|where|why|how|can i|am i|do i)\b"),
    ("faq", "words", r"\b(faqs?|frequently asked questions|questions and answers)\b"),
    ("supporting", "path", r"/reviewers?(/|$)"),
    ("supporting", "title", r"\bgrant review\b"),
    ("directory", "title", r"^applications for (?:the )?20\d{2} grant cycle\b"),
    ("guidelines", "title", r"\b(guidelines|application guide|instructions|fact sheet|eligibility requirements)\b"),
    ("guidelines", "path", r"/(guidelines|instructions)(/|$)"),
    ("announcement", "title", r"\b(recipients?|awardees?|winners?|announces?|awarded|receives?|finalists?)\b"),
    ("announcement", "path", r"/(news|news-and-views|press|press-releases|blog|stories)(/|$)"),
    ("directory", "title", r"\b(directory|resources?|toolkits?|grant search|funding overview|funding opportunities|grants overview)\b"),
    ("directory", "title", r"^(all |our |current |available )?(grants?|funding|fellowships?)( and (awards|fellowships|grants))?$"),
    ("supporting", "title", r"\b(office hours|orientation|webinars?|downloads?|manage (your|a) grant|reporting|technical assistance for grant applications|terms and conditions)\b"),
    ("supporting", "path", r"/(resource|resources|downloads|for-grantees|recipients|artists|people)(/|$)"),
    ("supporting", "title", r"\b(how (to|do|can)|tips for|why |what is|grant writer|project manager)\b"),
    ("application", "path", r"/(apply|apply-now|application|application-form|award-application)/?$"),
    ("application", "title", r"^(?:(?:grant )?application|apply now)$"),
    ("application", "title", r"^(apply for|application for)\b"),
    ("supporting", "path", r"\.(pdf|xml)$"),
)

#: Pages of single publishers, by host, and what their title, path or body hold.
PUBLISHER_RULES: tuple[tuple[str, str, str, str, str], ...] = (
    ("program", "www.spencer.org", r"^research-practice partnerships:", r"^/grant_types/research-practice-partnerships/?$", r"research-practice partnership \(rpp\) grants program"),
    ("announcement", "ambergrantsforwomen.com", "", "", "share this recipient on social media"),
    ("announcement", "www.rd.usda.gov", "^technical assistance awards$", "", "list of entities that received usda funding"),
)
#: How many rules of ``ROLE_RULES`` come before each of them.
PUBLISHER_AT = (8, 15, 15)

#: What a program's title and body name.
PROGRAM_TITLE = r"\b(grants?|fund|funding|fellowships?|awards?|program)\b"
PROGRAM_BODY = r"\b(apply|applications?|eligib\w*|proposals?|supports?|provides?|funding|award is made|awards are made)\b"

#: Why a page that is a program by its role is none by its name or path.
NON_PROGRAM_RULES: tuple[tuple[str, str, str], ...] = (
    ("Supporting page or recipient biography", "path", r"/(?:recipients?|guidelines|process|faq|assistance)(?:/|$)"),
    ("Supporting page or recipient biography", "title", r"^(?:about our funding|technical assistance for grant applications)$"),
    ("Announcement, biography, job, or supporting document", "title", r"\b(finalists?|announces?|receives?|judges|ceremony|lessons learned|grant writer|project manager|development manager|operations|tips for|rules|frequently asked|guidelines|applicant eligibility|terms and conditions|fact sheet|step-by-step|proposal and award process)\b"),
    ("Announcement, biography, job, or supporting document", "path", r"/(?:press|press-releases?|jobs?|careers?|artists?|people|bios?|stories)(?:/|$)"),
    ("General directory or supporting content", "title", r"^(?:manage|get|find) (?:a )?grants?$|^funding (?:at|for)\b|^how we\b|^applying for\b|^other grant|^educator grants and fellowships$|^we give grants\b|^where women\b|^small business grants for women in\b|^\d{4} womensnet|\bgrants? (?:listing|rules|has a secret)\b|\b\d+ terrific grants\b|\bawards (?:artist|shahzia)\b"),
    ("Article, author, or taxonomy page", "title", r"\b(pay-per-click|author at)\b"),
    ("Article, author, or taxonomy page", "path", r"/(?:author|tag|category)(?:/|$)"),
    ("Non-grant resource or directory", "title", r"\b(directory|archives?|resources?|toolkits?|contacts?|webinars?|recipients?|winners?|awarded|administer|reporting|news|blog)\b"),
    ("Non-grant resource or directory", "path", r"/(?:news|blog|resources|awards|administer|contacts|for-grantees)(?:/|$)"),
    ("Supporting document or ambiguous listing", "title", r"\b(how (?:do i|to)|apply for funding|application support|solicitations? & awards)\b"),
    ("Supporting document or ambiguous listing", "path", r"\.(?:pdf|xml)$"),
    ("General program directory", "title", r"^(?:(?:all|current|available|research|our)\s+)?(?:awards?\s*(?:&|and)\s*)?(?:grants?|funding|funding opportunities|fellowships?)(?:\s*(?:&|and)\s*opportunities|\s+programs?)?$"),
)
EVIDENCE_WORDS = r"\b(apply|application|applications|eligib\w*|proposals?|funding|supports?|provides?|awards?)\b"
QUOTES = "\"“”'‘’"


def _found(col: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, with ASCII word boundaries."""
    edge = f"(?:{X.START}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){X.STOP})"
    # Before a list of words an edge is a start: one look back a place and no more.
    pattern = re.sub(r"^\\b(?=\([a-z])", lambda _: X.START, pattern)
    return col.rlike("(?i)" + pattern.replace(r"\b", edge))


def page_role(title: Column, url: Column, body: Column) -> Column:
    """program, application, guidelines, faq, directory, announcement, supporting or
    ambiguous; nulls count as empty."""
    blank = F.lit("")
    title = F.regexp_replace(F.trim(F.coalesce(title, blank)), f"^[{QUOTES}]+|[{QUOTES}]+$", "")
    body, host, path = F.coalesce(body, blank), F.regexp_extract(url, "^https?://([^/?#]+)", 1), F.coalesce(X.path_of(url), blank)
    seen = {"title": title, "path": path, "words": F.concat(title, F.lit(" "), path)}
    rules = [(role, _found(seen[what], pattern)) for role, what, pattern in ROLE_RULES]
    for at, (role, at_host, by_title, by_path, by_body) in reversed(list(zip(PUBLISHER_AT, PUBLISHER_RULES, strict=True))):
        rules.insert(at, (role, (host == at_host) & _found(title, by_title) & _found(path, by_path) & _found(body, by_body)))
    program = F.length(title).between(8, 250) & _found(title, PROGRAM_TITLE) & _found(body, PROGRAM_BODY)
    out = F.when(rules[0][1], rules[0][0])
    for role, holds in rules[1:]:
        out = out.when(holds, role)
    return out.when(program, "program").otherwise("ambiguous")


def classify_candidate(title: Column, url: Column, body: Column) -> Column:
    """Why a page is no program to publish, or null."""
    name, path = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")), F.coalesce(X.path_of(url), F.lit(""))
    role = page_role(title, url, body)
    out = F.when(role != "program", F.concat(F.lit("Non-program or unresolved page: "), role))
    for reason, what, pattern in NON_PROGRAM_RULES:
        out = out.when(_found(name if what == "title" else path, pattern), reason)
    out = out.when(~F.length(name).between(8, 250), "No recognizable program title")
    return out.when(~_found(F.coalesce(body, F.lit("")), EVIDENCE_WORDS), "Insufficient program evidence")


def program_name(name: Column, url: Column, body: Column) -> Column:
    """Whether a name alone, apart from its url's path, is that of a program."""
    return page_role(name, F.concat(F.regexp_extract(url, "^https?://[^/?#]+", 0), F.lit("/program")), body) == "program"


# ---- the same rules as SQL that DuckDB runs --------------------------------------


def _sql_found(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')" if pattern else "true"


def role_sql(title: str, url: str, body: str) -> str:
    name = f"regexp_replace(trim(coalesce({title}, '')), '^[{QUOTES.replace(chr(39), chr(39) * 2)}]+|[{QUOTES.replace(chr(39), chr(39) * 2)}]+$', '', 'g')"
    path, host = f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)", f"regexp_extract({url}, '^https?://([^/?#]+)', 1)"
    seen = {"title": name, "path": path, "words": f"({name} || ' ' || {path})"}
    rules = [(role, _sql_found(seen[what], pattern)) for role, what, pattern in ROLE_RULES]
    for at, (role, at_host, by_title, by_path, by_body) in reversed(list(zip(PUBLISHER_AT, PUBLISHER_RULES, strict=True))):
        rules.insert(at, (role, f"{host} = '{at_host}' and {_sql_found(name, by_title)} and {_sql_found(path, by_path)} and {_sql_found(body, by_body)}"))
    rules.append(("program", f"length({name}) between 8 and 250 and {_sql_found(name, PROGRAM_TITLE)} and {_sql_found(body, PROGRAM_BODY)}"))
    return "case " + " ".join(f"when {holds} then '{role}'" for role, holds in rules) + " else 'ambiguous' end"


def classify_sql(title: str, url: str, body: str, role: str) -> str:
    name, path = f"trim(regexp_replace(coalesce({title}, ''), '\\s+', ' ', 'g'))", f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)"
    rules = "".join(f" when {_sql_found(name if what == 'title' else path, pattern)} then '{reason}'" for reason, what, pattern in NON_PROGRAM_RULES)
    return f"case when {role} <> 'program' then 'Non-program or unresolved page: ' || {role}{rules} when length({name}) not between 8 and 250 then 'No recognizable program title' when not {_sql_found(body, EVIDENCE_WORDS)} then 'Insufficient program evidence' end"
