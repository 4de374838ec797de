"""Facts and examples that pages state, and excerpts proven at a place of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions.exprs import now
from fundcat.operators.evidence import ascii_words
from fundcat.schema import AS_OF
from fundcat.sources.outline import AWARDED, LIST, SAMPLE

# ---- facts -------------------------------------------------------------------

#: What a summary is about, headings of eligibility sections, wordings of
#: dates, and one publisher whose program pages are read further.
SUMMARY = r"\b(grant|funding|fellowship|award)s?\b"
ELIGIBILITY_HEADING = r"^(?:eligibility(?: and restrictions)?|eligible applicants|who (?:may|can) apply(?: for this program)?\??|who is eligible\??)[:\s]*$"
DUE = r"(?:Application Deadline|Applications Due|Deadline)\s*:\s*"
NUMERIC_DATE = r"(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\b"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NAMED_DATE = rf"({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
ADAPTER, ADAPTER_HOST, ADAPTER_PATH = "spencer-program-v1", "www.spencer.org", "/grant_types/"
BUDGET = r"budgets up to \$([\d,]+)\b"
CLOSED_NOW = r"Applications (?:are |currently )?closed\.?|Applications Open:?\s*Now closed\.?"
OPEN_NOW = r"Applications are (?:currently )?open\.?"
MOST_AWARD = 100_000_000


def _all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(group))


def _is(text, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ascii_words(pattern))


def _official(url) -> Column:
    return F.startswith(F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", ""), F.lit(ADAPTER_HOST + ADAPTER_PATH))


def _numeric_date(found: Column) -> Column:
    raw = F.regexp_extract(found, ascii_words(DUE + NUMERIC_DATE), 1)
    us = F.split(raw, "/")
    iso = F.when(F.contains(raw, F.lit("/")), F.concat_ws("-", F.get(us, F.lit(2)), F.lpad(F.get(us, F.lit(0)), 2, "0"), F.lpad(F.get(us, F.lit(1)), 2, "0"))).otherwise(raw)
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def _named_date(found: Column) -> Column:
    part = lambda i: F.regexp_extract(found, ascii_words(DUE + NAMED_DATE), i)
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(part(1)))
    iso = F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0"))
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def html_facts(outlines: DataFrame) -> DataFrame:
    """``outlines`` -> one row per page with what it states, null where it does not: the
    first paragraph of 60 to 1500 characters about a grant, the eligibility section if
    there is just one, the deadline if there is one and it is a date; on the pages of one
    publisher also month-name deadlines, budgets and whether applications are open."""
    good = lambda t, least, most: F.length(t).between(least, most) & F.contains(F.col("text"), t)
    summary = F.get(F.filter("paragraphs", lambda p: F.length(p).between(60, 1500) & _is(p, SUMMARY)), F.lit(0))
    sections = F.filter("sections", lambda s: _is(s["heading"], ELIGIBILITY_HEADING) & good(s["text"], 40, 5000))
    rows = outlines.select(
        "page_id", "url", "text", _official("url").alias("official"), summary.alias("summary"), sections.alias("s"), _all("text", DUE + NUMERIC_DATE).alias("dated"), _all("text", DUE + NAMED_DATE).alias("named"),
        F.array_distinct(F.transform(_all("text", BUDGET, 1), lambda m: F.regexp_replace(m, ",", ""))).alias("budgets"), F.get(_all("text", BUDGET), F.lit(0)).alias("budget"), F.get(_all("text", CLOSED_NOW), F.lit(0)).alias("closed"), F.get(_all("text", OPEN_NOW), F.lit(0)).alias("open"),
    )
    one = F.when(F.size("dated") == 1, F.get("dated", F.lit(0)))
    by_name = F.when((F.size("named") == 1) & (F.size("dated") == 0), F.get("named", F.lit(0)))
    rows = rows.withColumn("due", F.when(F.col("official") & (F.size("named") > 0), F.struct(_named_date(by_name).alias("value"), by_name.alias("said"))).otherwise(F.struct(_numeric_date(one).alias("value"), one.alias("said"))))
    amount = F.try_element_at("budgets", F.lit(1)).cast("decimal(38,0)")
    paid = F.col("official") & (F.size("budgets") == 1) & amount.between(1, MOST_AWARD)
    state = F.when(F.col("official") & F.col("closed").isNotNull() & F.col("open").isNull(), "closed").when(F.col("official") & F.col("open").isNotNull() & F.col("closed").isNull(), "open")
    return rows.withColumn("status", state).select(
        "page_id", "url", "text", F.when(F.contains("text", "summary"), F.col("summary")).alias("summary"), F.when(F.size("s") == 1, F.get("s", F.lit(0))["text"]).alias("eligibility"),
        F.col("due.value").alias("deadline"), F.when(F.col("due.value").isNotNull(), F.col("due.said")).alias("deadline_evidence"), F.when(paid, amount.cast("string")).alias("maximum"), F.when(paid, F.lit("USD")).alias("currency"), F.when(paid, F.col("budget")).alias("amount_evidence"),
        "status", F.when(F.col("status") == "closed", F.col("closed")).when(F.col("status") == "open", F.col("open")).alias("status_evidence"), F.when(F.col("official"), F.lit(ADAPTER)).alias("official_adapter"),
    )


# ---- evidence ----------------------------------------------------------------

#: The least characters of an excerpt that can prove anything.
LEAST_EXCERPT = 12


def folded(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def excerpt_span(text, excerpt) -> Column:
    """Where an excerpt stands in a text, white space of one being any white space of the
    other: a struct of its first character and the one behind its last, counted from 0 in
    the text as it is; null if it is not there."""
    words = F.split(folded(excerpt), " ")
    literal = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|])", r"\\$1")), r"\s+")
    at = F.regexp_instr(F.coalesce(text, F.lit("")), literal)
    found = F.regexp_substr(F.coalesce(text, F.lit("")), literal)
    return F.when((at > 0) & (folded(excerpt) != ""), F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(found)).cast("long").alias("end")))


def evidence_check(claims: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """``claims(id, url, body)`` with the columns of ``html_facts`` -> the values whose
    excerpt the body holds, each with its span, and ``auto_verified``: only on the adapter's
    pages, with every fact there and an open round that has not ended. A null body proves
    nothing."""
    proves = lambda key: F.when(F.length(F.col(key)) >= LEAST_EXCERPT, excerpt_span(F.col("body"), F.col(key)))
    spans = {"summary": "summary", "eligibility": "eligibility", "status": "status_evidence", "maximum": "amount_evidence", "deadline": "deadline_evidence"}
    rows = claims.select("*", *[proves(key).alias(f"{field}_span") for field, key in spans.items()])
    has = lambda field: F.col(f"{field}_span").isNotNull()
    amount = F.col("maximum").cast("decimal(38,2)")
    day = F.try_to_date(F.when(F.col("deadline").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("deadline")), "yyyy-MM-dd")
    rows = rows.select(
        "id", "url", "official_adapter", *[f"{field}_span" for field in spans],
        F.when(has("summary"), F.col("summary")).alias("summary"), F.when(has("eligibility"), F.col("eligibility")).alias("eligibility"),
        F.when(F.col("status").isin("open", "closed") & has("status"), F.col("status")).otherwise("unknown").alias("status"),
        F.when((F.col("currency") == "USD") & has("maximum") & (amount > 0) & (amount <= MOST_AWARD), amount).alias("maximum"), F.when(has("deadline"), day).alias("deadline"),
    )
    consistent = (F.col("status") != "open") | (F.col("deadline").isNotNull() & (F.col("deadline") >= F.to_date(now(as_of))))
    whole = F.col("summary").isNotNull() & F.col("eligibility").isNotNull() & F.col("maximum").isNotNull() & F.col("deadline").isNotNull() & (F.col("status") != "unknown")
    official = _official("url") & (F.col("official_adapter") == ADAPTER)
    span = lambda f: F.when(F.col(f if f != "status" else "s").isNotNull(), F.col(f"{f}_span"))
    rows = rows.withColumn("s", F.nullif("status", F.lit("unknown")))
    placed = F.array_compact(F.array(*[F.when(span(f).isNotNull(), F.struct(F.lit(f).alias("field"), span(f)["start"].alias("start"), span(f)["end"].alias("end"))) for f in spans]))
    return rows.select("id", "summary", "eligibility", "status", "maximum", "deadline", F.coalesce(official & whole & consistent, F.lit(False)).alias("auto_verified"), placed.alias("spans"))


# ---- examples ----------------------------------------------------------------

#: Pictures that show nothing, wordings that deny, labels of blank forms.
NO_PICTURE = r"logo|icon|avatar|pixel|tracking|\.svg(?:$|\?)"
DENIED = r"\b(?:not|never|unsuccessful|rejected)\s+(?:a\s+)?(?:funded|supported|awarded|successful|recipient|application|proposal)|\bnot an? (?:example|sample)\b"
BLANK = r"\b(?:blank|template|guidelines|instructions|faq)\b"
MOST_CARDS, MOST_ATTACHED, EXCERPT_WORDS = 30, 12, 22
LEAST_NAME = 10
GRAM = 10


def _example(card: Column) -> Column:
    """What a card shows, or null."""
    title, context = card["title"], card["context"]
    kind = F.when(_is(F.concat_ws(" ", title, context), SAMPLE.pattern), "sample_application").when(_is(context, AWARDED.pattern), "funded_project")
    fits = kind.isNotNull() & card["url"].isNotNull() & (F.length(title) >= 5) & ~_is(title, LIST.pattern) & ~_is(title, BLANK) & ~_is(context, DENIED)
    year = F.nullif(F.regexp_extract(context, ascii_words(r"\b((?:19|20)\d{2})\b"), 1), F.lit(""))
    excerpt = F.array_join(F.slice(F.split(context, r"\s+"), 1, EXCERPT_WORDS), " ")
    image = F.when(~_is(card["image"], NO_PICTURE), card["image"])
    return F.when(fits, F.struct(card["place"].alias("place"), kind.alias("kind"), title.alias("title"), card["url"].alias("url"), excerpt.alias("excerpt"), year.alias("year"), image.alias("image"), card["alt"].alias("alt"), context.alias("context")))


def example_extract(outlines: DataFrame) -> DataFrame:
    """``outlines`` -> ``(page_id, page_url, own, place, kind, title, url, excerpt, year,
    image, alt, context)``: funded projects and sample applications that a page shows, its
    first 30 cards, and the one that the page is itself (``own``, place -1). Cards that are
    lists, blank forms or rejected say nothing."""
    cards = F.slice(F.array_compact(F.transform("cards", _example)), 1, MOST_CARDS)
    own = F.array_compact(F.array(_example(F.col("self"))))
    rows = outlines.select("page_id", F.col("url").alias("page_url"), F.explode(F.concat(own, cards)).alias("e"))
    return rows.select("page_id", "page_url", (F.col("e.place") < 0).alias("own"), "e.*")


def _named(cards: DataFrame, programs: DataFrame) -> DataFrame:
    """Pairs ``(page_id, place, id)`` of cards and programs whose name the card's context
    holds. Names of three words or more meet contexts on that of their inner words, which
    stand whole in a text, that is rarest among the contexts; shorter ones on their first
    ten characters. Then the whole name is looked for."""
    texts = cards.select("page_id", "place", F.lower("context").alias("said"))
    words = texts.select("page_id", "place", F.explode(F.array_distinct(F.split("said", " "))).alias("key"))
    names = programs.select("id", F.lower(folded(F.col("name"))).alias("name")).where(F.length("name") >= LEAST_NAME)
    parts = F.split("name", " ")
    long = names.where(F.size(parts) > 2).select("id", "name", F.explode(F.array_distinct(F.slice(parts, 2, F.size(parts) - 2))).alias("key"))
    counts = words.join(long.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A name with an inner word that no context has meets none.
    rarest = long.join(counts, "key", "left").groupBy("id", "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).where("k.n > 0").select("id", "name", "k.key")
    short = names.where(F.size(parts) <= 2).select("id", "name", F.substring("name", 1, GRAM).alias("key"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("said") - GRAM + 1), lambda i: F.substr("said", i, F.lit(GRAM))))
    grams = texts.where(F.length("said") >= GRAM).select("page_id", "place", F.explode(starts).alias("key")).join(short.select("key").distinct(), "key", "left_semi")
    met = words.join(rarest, "key").unionByName(grams.join(short, "key")).select("page_id", "place", "id", "name")
    return met.join(texts, ["page_id", "place"]).where(F.contains("said", "name")).select("page_id", "place", "id").distinct()


def example_attach(examples: DataFrame, programs: DataFrame, primary: DataFrame) -> DataFrame:
    """``examples`` of ``example_extract``, ``programs(id, name, source_url)`` with
    canonical urls, ``primary(page_id, id)`` pages of a program itself -> the examples of
    each program and page: all cards of its own pages, elsewhere those whose context names
    it, the page itself first. The program is no example of itself; a url counts once a
    page, in its first place and as last said; at most twelve a page."""
    own = examples.where("not own").select("page_id", "place").join(primary.select("page_id", "id").distinct(), "page_id")
    named = _named(examples, programs).join(primary.select("page_id", "id").distinct(), ["page_id", "id"], "left_anti")
    pairs = own.select("page_id", "place", "id").unionByName(named)
    rows = pairs.join(examples, ["page_id", "place"]).join(programs.select("id", F.lower(folded(F.col("name"))).alias("_name"), F.col("source_url").alias("_url")), "id")
    rows = rows.where((F.col("url") != F.col("_url")) & (F.lower("title") != F.col("_name")))
    said = ["kind", "title", "excerpt", "year", "image", "alt"]
    once = rows.groupBy("id", "page_id", "page_url", "url").agg(F.min("place").alias("place"), F.max_by(F.struct(*said), F.col("place")).alias("e"))
    order = Window.partitionBy("id", "page_id").orderBy("place")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_ATTACHED).select("id", "page_id", "page_url", "n", "url", "e.*")


def family_examples(attached: DataFrame, families: DataFrame, pages: DataFrame) -> DataFrame:
    """``attached`` of all programs merged into one, ``pages(page_id, fetched_at)`` -> the
    examples of the family, those of its newest pages first, each url once, at most twelve."""
    rows = attached.join(families.select("id", "family"), "id").join(pages.select("page_id", "fetched_at"), "page_id")
    first = rows.groupBy("family", "url").agg(F.min_by(F.struct("kind", "title", "excerpt", "year", "image", "alt", "fetched_at", "page_id", "n"), F.struct((-F.unix_micros("fetched_at")).alias("at"), "page_id", "n")).alias("e"))
    order = Window.partitionBy("family").orderBy(F.desc("e.fetched_at"), "e.page_id", "e.n", "url")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_ATTACHED).select("family", "place", "url", "e.kind", "e.title", "e.excerpt", "e.year", "e.image", "e.alt")
