"""Column expressions of the catalog. Word boundaries are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundcat.schema import AS_OF, FOCUS

START, STOP = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def now(as_of: str = AS_OF) -> Column:
    return F.to_timestamp(F.lit(as_of))


def days(n: int) -> Column:
    return F.expr(f"interval {n} days")


def word(col, pattern: str) -> Column:
    """Whether whole words of the pattern occur, in any case."""
    return F.col(col).rlike(f"(?i){START}(?:{pattern}){STOP}") if isinstance(col, str) else col.rlike(f"(?i){START}(?:{pattern}){STOP}")


def once(expr: Column) -> Column:
    """A long expression as a column that later ones refer to: generated, so that the
    optimizer does not write it out in each of them."""
    return F.explode(F.array(expr))


def visible() -> Column:
    """Programs that the public sees."""
    return ~F.col("is_demo") & F.col("merged_into").isNull() & (F.col("publication_state") == "published") & (F.col("verification_status") != "archived")


def round_status(as_of: str = AS_OF) -> Column:
    """Status of the application round. ``state`` is the monitor's, null if none."""
    today, ended = F.to_date(now(as_of)), F.col("deadline") < F.to_date(now(as_of))
    return (
        F.when(F.col("state") == "discontinued", "discontinued")
        .when(F.col("opens") > today, "upcoming")
        .when((ended | (F.col("application_status") == "closed")) & F.col("recurrence").isin("annual", "recurring"), "between_rounds")
        .when(ended, "round_ended")
        .when((F.col("application_status") == "upcoming") & (F.col("opens") <= today), "unknown")
        .otherwise(F.col("application_status"))
    )


def status_rank(col="status") -> Column:
    """Order of cards by status."""
    order = ("open", "upcoming", "between_rounds", "unknown", "unannounced", "round_ended", "closed", "discontinued")
    out = F.when(F.col(col) == order[0], 0)
    for i, s in enumerate(order[1:], 1):
        out = out.when(F.col(col) == s, i)
    return out.otherwise(8)


def search_rank(col="status") -> Column:
    """Order of the catalog search, which puts all ended rounds together."""
    return F.least(status_rank(col), F.lit(5))


def focus_tags(text) -> Column:
    """Population-focus tags that a text names, in alphabetical order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(word(text, p), F.lit(tag)) for tag, p in FOCUS.items()])))


def program_key(title) -> Column:
    """A title without years, some publishers' words and everything but letters and
    digits; on ASCII titles."""
    out = F.regexp_replace(F.lower(title), rf"{START}(19|20)[0-9]{{2}}(?:[-–][0-9]{{2,4}})?{STOP}", "")
    out = F.regexp_replace(out, f"{START}(the|usda|nea|nsf|spencer){STOP}", "")
    return F.regexp_replace(out, "[^a-z0-9]", "")


def host_of(url) -> Column:
    return F.regexp_replace(F.regexp_extract(url, "^https?://([^/?#]+)", 1), "^www\\.", "")


def path_of(url) -> Column:
    return F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)


def check_hours(as_of: str = AS_OF) -> Column:
    """Hours to the next check: near dates 6, closed rounds 168 or 24, others 24."""
    near = lambda c: F.col(c).between(F.to_date(now(as_of)), F.date_add(F.to_date(now(as_of)), 30))
    closed = F.when(F.col("recurrence").isin("annual", "recurring"), 24).otherwise(168)
    return F.when(near("opens"), 6).when(F.col("application_status") == "closed", closed).when(near("deadline"), 6).otherwise(24)


def backoff_hours(failures) -> Column:
    return F.least(F.lit(168), F.pow(F.lit(2), F.least(failures, F.lit(7)))).cast("int")


def backoff_seconds(failures, kind: str) -> Column:
    """Seconds to the next try: of a page, a search (from five minutes to a day) or a feed
    (from a quarter of an hour to a day)."""
    grown = lambda first, most: F.least(F.lit(86400), F.lit(first) * F.pow(F.lit(2), F.least(failures, F.lit(most)))).cast("long")
    return {"page": backoff_hours(failures).cast("long") * 3600, "search": grown(300, 8), "feed": grown(900, 6)}[kind]


def source_date(text) -> Column:
    """A valid ISO or US date, else null."""
    iso = F.regexp_extract(text, "^\\s*(\\d{4}-\\d{2}-\\d{2})", 1)
    us = F.regexp_extract(text, "^\\s*(\\d{1,2}/\\d{1,2}/\\d{4})", 1)
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(us, F.lit("")), "M/d/yyyy"))


def parse_amount(text) -> Column:
    """``$1,234.50`` and word scales as a number of at most 999 999 999 999."""
    number = F.regexp_replace(F.regexp_extract(text, "\\$?\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)", 1), ",", "")
    scale = F.lower(F.regexp_extract(text, "(?i)[0-9]\\s*(million|thousand|billion|k|m)(?![A-Za-z])", 1))
    times = F.when(scale.isin("k", "thousand"), 1e3).when(scale.isin("m", "million"), 1e6).when(scale == "billion", 1e9).otherwise(1.0)
    value = F.nullif(number, F.lit("")).cast("double") * times
    return F.when(value <= 999_999_999_999, value)


def scrub(text) -> Column:
    """A text without e-mail addresses, phone numbers and postal codes."""
    out = F.regexp_replace(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", " ")
    out = F.regexp_replace(out, "(?:\\+?1[-. ]?)?\\(?[0-9]{3}\\)?[-. ][0-9]{3}[-. ][0-9]{4}", " ")
    return F.regexp_replace(out, f"{START}[0-9]{{5}}(?:-[0-9]{{4}})?{STOP}", " ")


def words_in(text) -> Column:
    trimmed = F.regexp_replace(text, "^[ \\n\\r\\t]+|[ \\n\\r\\t]+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, "[ \\n\\r\\t]+")))


def schedule_day(ts) -> Column:
    """The crawl's day in New York, which starts at six."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    return F.to_date(F.when(F.hour(local) < 6, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local)))
