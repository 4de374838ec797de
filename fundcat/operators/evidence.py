"""Facts from page texts, and what pages say about programs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.functions import roles as P
from fundcat.functions.places import explicit_place

MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December)"
DAY = r"(\d{1,2}),?\s+(20\d{2})"
#: The wordings that state a fact.
MAXIMUM = r"(?:maximum grant amount|grant amounts? up to|maximum award|grants? of up to|budgets up to)\s*:?\s*(?:USD\s*\$?|\$)([\d,]+(?:\.\d+)?)\s*(million\b|thousand\b|billion\b|[mk]\b)?"
MINIMUM = r"(?:minimum grant amount|minimum award)\s*:?\s*(?:USD\s*\$?|\$)([\d,]+(?:\.\d+)?)\s*(million\b|thousand\b|billion\b|[mk]\b)?"
RANGE = r"(?:grant|award|funding) amounts?\s*(?:range\s*)?(?:from|of|between|:)?\s*\$([\d,]+)\s*(?:to|[-–]|and)\s*\$([\d,]+)"
ROLLING = r"applications (?:are )?(?:accepted|reviewed) (?:on a rolling basis|year[- ]round)|(?:application )?deadline\s*:\s*rolling"
ELIGIBLE = r"(?:eligible applicants (?:include|are)|(?:this (?:grant|program) is )?open to|applicants must be)\s+(?:U\.S\.|e\.g\.|i\.e\.|[^.!?\n]){5,1200}(?:[.!?](?=\s|$)|$)"
RESIDENCY = r"(?:applicants must (?:reside|be based|be located)|eligible applicants (?:reside|are based)) in ([^.!?\n]{2,150})(?:[.!?]|$)"
DEADLINE_ISO = r"(?:application deadline|applications due|deadline)\s*:\s*(20\d{2}-\d{2}-\d{2})\b"
DEADLINE_MONTH = rf"(?:application deadline|applications (?:are )?due|deadline)\s*(?::|is)?\s*{MONTH}\s+{DAY}\b"
OPENS = rf"applications (?:will )?open\s*:?\s*{MONTH}\s+{DAY}\b"
STATUS = r"(?:[^.!?\n]{0,65}\b)?applications (?:are |are currently |currently |now )?(?:open|closed|being accepted|not being accepted)\b[^.!?\n]{0,100}[.!?]?"
DATED_OPENING = rf"applications open\s*:?\s*(?:{MONTH[1:-1]}|\d)"
PAST_OR_FUTURE = r"\b(were|was|previous|last year|will|opens|historical)\b"
RECURRENCE = r"(?:this |the )(?:grant|program|fellowship|award)(?: program)? (?:is (?:offered|awarded|available)|runs|accepts applications) (annually|every year|each year|twice a year|quarterly|monthly)\b"
NO_LONGER = r"\b(?:not|no longer|previously|formerly)\b"
ONE_TIME = r"(?:this|the) (?:grant|program|fellowship|award) is (?:a )?one[- ]time (?:grant|program|opportunity|award)\b"
CLOSE = rf"applications close\s+(?:(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+)?{MONTH}\s+(\d{{1,2}})\b"
CYCLE_TITLE, CYCLE_TEXT = r"(?:FY\s*)?20\d{2}(?:\s*[-–/]\s*(?:20)?\d{2})?", r"(?:FY\s*20\d{2}|20\d{2}(?:\s*[-–/]\s*(?:20)?\d{2})?\s+(?:funding|application|grant)\s+(?:round|cycle|period))"
CYCLE_YEARS = r"20\d{2}(?:\s*[-–/]\s*(?:20)?\d{2})?"
OTHER_MONEY, EXCLUDING = r"\b(CAD|AUD|NZD|Canadian dollars|Australian dollars)\b", r"\b(not|except|excluding|ineligible)\b"
APPLICANTS = ((r"\bnonprofit|501\(c\)\(3\)", "nonprofit"), (r"\bsmall businesses|for-profit businesses", "business"), (r"\bindividual(?:s| artists)?\b", "individual"), (r"\bstudents?\b", "student"), (r"\bresearchers?\b", "researcher"), (r"\bfiscally sponsored", "fiscal_sponsored"))
LARGEST = 100_000_000
DUE = ("deadline", "applications due", "applications are due")

_FACT = "array<struct<field:string,value:string,excerpt:string,rule:string,conflict:boolean>>"


def ascii_words(pattern: str) -> str:
    r"""The pattern in any case, ``\b`` being an ASCII word's edge."""
    edge = f"(?:{X.START}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){X.STOP})"
    return "(?i)" + pattern.replace(r"\b", edge)


def _has(col: Column, pattern: str) -> Column:
    return col.rlike(ascii_words(pattern))


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, ascii_words(pattern), n)


def _says(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text in lower case has one of the wordings."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _matches(pattern: str, words: tuple[str, ...], ends: str = "", near: Callable[[Column], Column] = lambda part: part) -> Column:
    """All matches of a pattern in ``body``, whose lower case is ``low``. Every match holds
    one of ``words``, so other texts are not searched. No match goes beyond one of the
    characters ``ends`` but by it: patterns with room before their words are tried in the
    parts between them that have the words, or in what is ``near`` them, and not from each
    place of the text."""
    find = lambda t: F.regexp_extract_all(t, F.lit(ascii_words(pattern)), F.lit(0))
    parts = F.filter(F.split("body", f"(?<=[{ends}])"), lambda p: _says(F.lower(p), words)) if ends else None
    found = F.flatten(F.transform(parts, lambda p: find(near(p)))) if ends else find(F.col("body"))
    return F.when(_says(F.col("low"), words), found).otherwise(F.array().cast("array<string>"))


def _near_applications(part: Column) -> Column:
    """What of a sentence ``STATUS`` can match: from 65 characters before its first
    "applications" to the longest wording behind its last. Other places would each be
    tried for nothing."""
    lead, upto = F.length(F.regexp_extract(part, "(?is)^(.*?)applications", 1)), F.length(F.regexp_extract(part, "(?is)^.*applications", 0))
    start = F.greatest(F.lit(1), lead - 69)
    return F.substring(part, start, upto + 200 - start)


def _facts(matches: Column, make: Callable[[Column], list[tuple[Column, str, Column]]], excerpt: str = "") -> Column:
    """Facts of every match: ``make`` gives (whether, field, value) for a match. The
    excerpt is the match, or the part of it that is of a pattern of its own."""

    def of(m: Column) -> Column:
        return F.array_compact(F.array(*[F.when(holds & value.isNotNull(), F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), (_group(m, excerpt, 0) if excerpt else m).alias("excerpt"), F.lit(f"explicit-program-{field}").alias("rule"), F.lit(False).alias("conflict"))) for holds, field, value in make(m)]))

    return F.flatten(F.transform(matches, of)).cast(_FACT)


def _amount(text: Column, scale: Column | None = None) -> Column:
    number = F.replace(text, F.lit(",")).try_cast("decimal(20,2)")
    times = F.lit(1) if scale is None else F.when(F.lower(scale).isin("k", "thousand"), 1000).when(F.lower(scale).isin("m", "million"), 1_000_000).when(F.lower(scale) == "billion", 1_000_000_000).otherwise(1)
    value = (number * times).cast("decimal(30,2)")
    return F.when((value > 0) & (value <= LARGEST), value)


def _plain(value: Column) -> Column:
    """A number without needless zeros."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.regexp_replace(value.cast("string"), "0$", ""))


def _date(month: Column, day: Column, year: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws(" ", F.initcap(F.lower(month)), day, year), "MMMM d yyyy"), "yyyy-MM-dd")


def text_facts(pages: DataFrame) -> DataFrame:
    """``pages(id, url, title, body, fetched_at)`` -> ``(id, url, fetched_at, field, value,
    excerpt, cycle, rule, conflict)``, a row per stated fact. Directories, announcements
    and pages of unclear role state none. A fact's cycle is the page's, else the one year
    of its excerpt (``unresolved`` if there are several), else that of the only deadline.

    Pages are dealt out first, as one task reads a whole file of one row group. A rule
    searches the texts alone that have its words."""
    body = F.col("body")
    yes = F.lit(True)
    ours = lambda m: ~_has(body, OTHER_MONEY) | m.contains("USD")
    single = lambda p, field: lambda m: [(ours(m), field, _plain(_amount(_group(m, p, 1), _group(m, p, 2))))]

    def span(m: Column) -> list:
        low, high = _amount(_group(m, RANGE, 1)), _amount(_group(m, RANGE, 2))
        fits = ~_has(body, OTHER_MONEY) & (high >= low)
        return [(fits, "minimum", _plain(low)), (fits, "maximum", _plain(high))]

    def applicants(m: Column) -> list:
        kinds = F.array_sort(F.array_compact(F.array(*[F.when(_has(m, p), kind) for p, kind in APPLICANTS])))
        return [(~_has(m, EXCLUDING) & (F.size(kinds) > 0), "applicants", F.to_json(kinds))]

    def place(m: Column) -> list:
        found = explicit_place(_group(m, RESIDENCY, 1))
        return [(found.isNotNull(), "geography", F.to_json(found))]

    iso = lambda m: [(yes, "deadline", F.date_format(F.try_to_date(_group(m, DEADLINE_ISO, 1), "yyyy-MM-dd"), "yyyy-MM-dd"))]
    dated = lambda p, field: lambda m: [(yes, field, _date(_group(m, p, 1), _group(m, p, 2), _group(m, p, 3)))]
    status = lambda m: [(~_has(m, DATED_OPENING) & ~_has(m, PAST_OR_FUTURE), "status", F.when(_has(m, "closed|not being accepted"), "closed").otherwise("open"))]
    before = rf"[^.!?]{{0,100}}{RECURRENCE}"
    recurs = lambda m: [(~_has(F.regexp_extract(m, ascii_words(rf"^([^.!?]*?){RECURRENCE}"), 1), NO_LONGER), "recurrence", F.when(_has(m, "(annually|every year|each year)$"), "annual").otherwise("recurring"))]

    clauses = F.array_distinct(F.filter("eligible", lambda m: ~_has(m, EXCLUDING)))
    whole = F.array_join(clauses, " ")
    eligibility = F.when(F.size(clauses) > 0, F.array(F.struct(F.lit("eligibility").alias("field"), whole.alias("value"), F.element_at(clauses, 1).alias("excerpt"), F.lit("eligibility-excerpt").alias("rule"), F.lit(False).alias("conflict")))).otherwise(F.array().cast(_FACT)).cast(_FACT)
    rules = [
        eligibility,
        _facts(F.col("eligible"), applicants),
        _facts(_matches(MAXIMUM, ("maximum grant amount", "grant amount", "maximum award", "grants of up to", "grant of up to", "budgets up to")), single(MAXIMUM, "maximum")),
        _facts(_matches(RANGE, ("grant amount", "award amount", "funding amount")), span),
        _facts(_matches(MINIMUM, ("minimum grant amount", "minimum award")), single(MINIMUM, "minimum")),
        _facts(_matches(ROLLING, ("applications a", "applications r", "rolling")), lambda m: [(yes, "rolling", F.lit("true")), (_has(m, "accepted"), "status", F.lit("open"))]),
        _facts(_matches(RESIDENCY, ("applicants must ", "eligible applicants ")), place),
        _facts(_matches(DEADLINE_ISO, DUE), iso),
        _facts(_matches(STATUS, ("applications are ", "applications currently ", "applications now ", "applications open", "applications closed", "applications being", "applications not being"), r".!?\n", _near_applications), status),
        _facts(_matches(DEADLINE_MONTH, DUE), dated(DEADLINE_MONTH, "deadline")),
        _facts(_matches(before, ("annually", "every year", "each year", "twice a year", "quarterly", "monthly"), ".!?"), recurs, RECURRENCE),
        _facts(_matches(ONE_TIME, ("one-time", "one time")), lambda m: [(yes, "recurrence", F.lit("one_time"))]),
        _facts(_matches(OPENS, ("applications open", "applications will open")), dated(OPENS, "opens")),
    ]
    dealt = pages.select("id", "url", "title", "body", "fetched_at").repartition("id", "url")
    # As a generated column the role is decided where the page is dealt to, not before.
    stating = dealt.withColumn("role", X.once(P.page_role(F.col("title"), F.col("url"), body))).where("role not in ('directory', 'announcement', 'ambiguous')")
    stating = stating.withColumn("low", X.once(F.lower(body))).withColumn("eligible", X.once(_matches(ELIGIBLE, ("eligible applicants ", "open to", "applicants must be"))))
    named, said = _group(F.coalesce("title", F.lit("")), CYCLE_TITLE, 0), F.when(F.contains(body, F.lit("20")), _group(body, CYCLE_TEXT, 0)).otherwise("")
    page_cycle = F.nullif(F.regexp_replace(F.regexp_extract(F.when(named != "", named).otherwise(said), CYCLE_YEARS, 0), r"\s", ""), F.lit(""))
    rows = stating.select("id", "url", "fetched_at", "body", "low", page_cycle.alias("page_cycle"), X.once(F.concat(*rules)).alias("facts"))
    # An opening with a date says nothing on today; a closing day other than the deadline's
    # is a conflict of the timeline.
    opening = F.when(_says(F.col("low"), ("applications open",)), F.regexp_extract(body, ascii_words(OPENS.replace("(?:will )?", "")), 0)).otherwise("")
    unclear = F.when((opening != "") & ~F.exists("facts", lambda f: f["field"] == "status"), F.array(F.struct(F.lit("status").alias("field"), F.lit("unknown").alias("value"), opening.alias("excerpt"), F.lit("dated-opening").alias("rule"), F.lit(True).alias("conflict")))).otherwise(F.array().cast(_FACT)).cast(_FACT)
    due = F.filter("facts", lambda f: f["field"] == "deadline")
    day = lambda m: F.substring(_date(_group(m, CLOSE, 1), _group(m, CLOSE, 2), F.lit("2024")), 6, 5)
    closes = F.flatten(F.transform(_matches(CLOSE, ("applications close",)), lambda m: F.transform(F.filter(due, lambda d: F.substring(d["value"], 6, 5) != day(m)), lambda d: F.struct(F.lit("deadline").alias("field"), d["value"].alias("value"), m.alias("excerpt"), F.lit("conflicting-timeline").alias("rule"), F.lit(True).alias("conflict")))))
    rows = rows.select("id", "url", "fetched_at", "page_cycle", due.alias("due"), F.explode(F.concat("facts", unclear, closes.cast(_FACT))).alias("f"))

    def cycle(excerpt: Column) -> Column:
        years = F.array_distinct(F.regexp_extract_all(excerpt, F.lit(ascii_words(r"(?:\b|FY\s*)(20\d{2})\b")), F.lit(1)))
        return F.coalesce("page_cycle", F.when(F.size(years) == 1, F.get(years, F.lit(0))).when(F.size(years) > 1, "unresolved"))

    own = cycle(F.col("f.excerpt"))
    only = F.when(F.size("due") == 1, cycle(F.get("due", F.lit(0))["excerpt"]))
    return rows.select("id", "url", "fetched_at", "f.field", "f.value", "f.excerpt", F.coalesce(own, only).alias("cycle"), "f.rule", "f.conflict")


#: How a page says that a program has ended or is back, and doubts.
SUBJECTS = r"this (?:grant|program|fund|fellowship)|the program"
RETIRED = r"(?:has been (?:permanently )?discontinued|is (?:permanently discontinued|no longer offered|permanently closed)|will no longer be offered)\b"
RETURNED = r"(?:is (?:now |once again )?(?:accepting applications|open for applications)|has (?:reopened|resumed))\b"
DOUBT = r"\b(if|unless|might|may|could)\b"
TEMPORARY = r"\b(until|this (?:year|cycle|round|season)|temporarily)\b"


def lifecycle_signal(pages: DataFrame) -> DataFrame:
    """``pages(id, name, title, text)`` -> ``(id, state, evidence)``: the sentence in which
    a page that has the program in its title says that it has ended or is open again. The
    sentence begins with the program, whose name may hold full stops, at the text's start or
    behind the end of another; the first such sentence counts. Sentences that doubt or limit
    it say nothing; rows without a signal are left out."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    about = pages.where((F.length(bare("name")) >= 8) & F.contains(bare("title"), bare("name")))
    name = F.regexp_replace("name", r"([.*+?^${}()|\[\]\\])", r"\\$1")

    def first(verb: str) -> Column:
        pattern = F.concat(F.lit(rf"(?i)(?:^|[.!?]\s+)(?:{SUBJECTS}|"), name, F.lit(ascii_words(rf") {verb}[^.!?]*[.!?]?").removeprefix("(?i)")))
        return F.regexp_replace(F.regexp_substr("text", pattern), r"^[.!?]\s+", "")

    rows = about.select("id", first(RETIRED).alias("ended"), first(RETURNED).alias("back"))
    ended = F.col("ended").isNotNull() & ~_has(F.col("ended"), DOUBT) & ~_has(F.col("ended"), TEMPORARY)
    back = F.col("back").isNotNull() & ~_has(F.col("back"), DOUBT)
    state = F.when(ended, F.struct(F.lit("discontinued").alias("state"), F.col("ended").alias("evidence"))).when(back, F.struct(F.lit("active").alias("state"), F.col("back").alias("evidence")))
    return rows.select("id", state.alias("s")).where("s is not null").select("id", "s.state", "s.evidence")


#: Publishers whose pages carry a program's number.
NUMBERED = (("nyfa.org", "opportunity-info"), ("grants.gov", "/search-results-detail/"))


def publisher_identity(url: Column) -> Column:
    """What a canonical url identifies: host and number for two publishers, else the url
    without www and closing slash."""
    host, path = X.host_of(url), X.path_of(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    number = F.regexp_extract(query, "[?&]id=([^&]+)", 1)
    rest = F.regexp_replace(path, "/+$", "")
    return (
        F.when((host == NUMBERED[0][0]) & path.contains(NUMBERED[0][1]) & (number != ""), F.concat(host, F.lit(":"), number))
        .when((host == NUMBERED[1][0]) & path.rlike(f"^{NUMBERED[1][1]}[0-9]+/?$"), F.concat(host, F.lit(":"), F.regexp_extract(path, "([0-9]+)", 1)))
        .otherwise(F.concat(F.lit("https://"), host, F.when(rest == "", "/").otherwise(rest), query))
    )


#: Roles of pages that add to a program's own, and how a page belongs to it.
SUPPORTING_ROLES = ("application", "guidelines", "faq", "supporting")


def related_pages(pages: DataFrame, programs: DataFrame, links: DataFrame) -> DataFrame:
    """``pages(id, url, title, body)``, ``programs(id, name, source_url)``, ``links(url,
    link)`` -> ``(page_id, opportunity_id, association)``: the same identity; a supporting
    page below the program's path; or one that the program's page links to and that names
    the program. A page is listed under its identity, its path's parents and its url, a
    program under what it is found by, and they meet in one equi-join."""
    host, path = X.host_of(F.col("url")), F.regexp_replace(X.path_of(F.col("url")), "/+$", "")
    g = programs.select(F.col("id").alias("opportunity_id"), "name", "source_url", publisher_identity(F.col("source_url")).alias("identity"), X.host_of(F.col("source_url")).alias("host"), F.regexp_replace(X.path_of(F.col("source_url")), "/+$", "").alias("parent"))
    name = F.lower(F.trim(F.regexp_replace("name", r"(?i)\s*[-|–]\s*(?:home|official site).*$", "")))
    linked = links.select(F.col("url").alias("source_url"), F.col("link").alias("url")).distinct().join(g.withColumn("said", name).where("length(said) >= 12"), "source_url")
    way = lambda rows, key, association, order, said=F.lit(None), host=F.lit(None): rows.select(key.alias("key"), "opportunity_id", F.lit(association).alias("association"), F.lit(order).alias("order"), said.cast("string").alias("said"), host.cast("string").alias("own_host"))
    ways = way(g, F.concat(F.lit("is "), F.col("identity")), "explicit-program-identifier", 0)
    ways = ways.unionByName(way(g.where("parent <> ''"), F.concat(F.lit("below "), F.col("host"), F.col("parent")), "official-program-subpage", 1))
    ways = ways.unionByName(way(linked, F.concat(F.lit("link "), F.col("url")), "official-program-link", 2, F.col("said"), F.col("host")))
    # A page is read once: its role is decided, and the text goes with its link alone.
    p = pages.select("id", "url", "body", publisher_identity(F.col("url")).alias("identity"), host.alias("host"), path.alias("path"), X.once(P.page_role(F.col("title"), F.col("url"), F.col("body"))).alias("role"))
    steps = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(steps) - 1)), lambda n: F.concat(F.lit("below "), F.col("host"), F.array_join(F.slice(steps, 1, n), "/")))
    none, adds = F.array().cast("array<string>"), F.col("role").isin(*SUPPORTING_ROLES)
    keys = F.concat(F.array(F.concat(F.lit("is "), F.col("identity"))), F.when(adds & (F.size(steps) > 2), parents).otherwise(none), F.when(adds, F.array(F.concat(F.lit("link "), F.col("url")))).otherwise(none))
    p = p.select("id", "host", "body", F.explode(F.array_compact(keys)).alias("key")).select("id", "host", "key", F.when(F.startswith("key", F.lit("link ")), F.lower("body")).alias("text"))
    every = p.join(ways, "key").where("order < 2 or (host = own_host and contains(text, said))").select(F.col("id").alias("page_id"), "opportunity_id", "association", "order")
    return every.groupBy("page_id", "opportunity_id").agg(F.min_by("association", "order").alias("association"))


def attach_evidence(associations: DataFrame, pages: DataFrame, facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Associated pages become a program's evidence: the evidence table with one row per
    program and url, the newest fetch in place of older ones; round evidence of pages that
    state dates or status; and alias urls. Unresolved and historical associations carry no
    facts, and historical ones no alias."""
    per_page = facts.groupBy(F.col("id").alias("page_id")).agg(F.count(F.lit(1)).alias("n_facts"), F.max(F.col("field").isin("deadline", "opens", "status", "rolling")).alias("dated"))
    silent = F.col("association").isin("catalog-source-context-unresolved", "historical-examples-only")
    rows = associations.join(pages.select(F.col("id").alias("page_id"), "url", "fetched_at"), "page_id").join(per_page, "page_id", "left")
    rows = rows.select("opportunity_id", "url", "association", F.col("page_id").alias("snapshot_id"), "fetched_at", F.when(silent, F.lit(0)).otherwise(F.coalesce("n_facts", F.lit(0))).cast("long").alias("n_facts"), (F.coalesce("dated", F.lit(False)) & ~silent).alias("dated"))
    columns = ["opportunity_id", "url", "association", "snapshot_id", "fetched_at", "n_facts"]
    both = rows.select(*columns, F.lit(1).alias("new")).unionByName(evidence.select(*columns, F.lit(0).alias("new")))
    kept = both.groupBy("opportunity_id", "url").agg(F.max(F.struct("new", "fetched_at", "snapshot_id", "association", "n_facts")).alias("e")).select("opportunity_id", "url", "e.association", "e.snapshot_id", "e.fetched_at", "e.n_facts")
    rounds = rows.where("dated").groupBy("opportunity_id", "snapshot_id").agg(F.max("url").alias("source_url"), F.max("fetched_at").alias("fetched_at"))
    aliases = rows.where("association <> 'historical-examples-only'").groupBy("url").agg(F.min("opportunity_id").alias("opportunity_id"))
    return kept, rounds, aliases


def round_history(families: DataFrame, rounds: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """``families(id, family)``, ``rounds(opportunity_id, snapshot_id, source_url,
    fetched_at)``, ``facts`` -> the opening and closing dates of a program and of those
    merged into it, from its ``most`` newest rounds, each date of a url once."""
    rows = rounds.join(families.select(F.col("id").alias("opportunity_id"), "family"), "opportunity_id")
    newest = Window.partitionBy("family").orderBy(F.desc("fetched_at"), "source_url", "snapshot_id")
    rows = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    said = facts.where("field in ('deadline', 'opens') and not conflict").select(F.col("id").alias("snapshot_id"), "field", "value")
    return rows.join(said, "snapshot_id").groupBy("family", "field", "value", "source_url").agg(F.max("fetched_at").alias("checked"))
