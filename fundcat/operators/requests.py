"""Search requests: raw parameters to bounded filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundcat.schema import APPLICANT_TYPES, CATEGORIES, FOCUS, STATUSES

#: What the parameters may be, and the largest page and amount.
RESULT_TYPES, FRESHNESS = ("programs", "catalog", "all", "leads"), ("new", "updated")
LOCATIONS, SORTS = ("nyc", "nyc_only", "any"), ("recommended", "deadline", "amount", "recent")
LAST_PAGE, MOST_MONEY, LONGEST_Q = 10_000, 100_000_000.0, 200
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _allowed(col: str, options: tuple[str, ...], default: str = "") -> Column:
    return F.when(F.col(col).isin(*options), F.col(col)).otherwise(default)


def _number(col: Column) -> Column:
    return F.when(F.trim(col).rlike(NUMBER), F.trim(col).try_cast("double"))


def _page(*cols: Column) -> Column:
    """The first parameter that is given, as a page; 1 if it is no positive integer."""
    n = _number(F.coalesce(*(F.when(c != "", c) for c in cols)))
    return F.when((n > 0) & (n == F.floor(n)), F.least(n, F.lit(float(LAST_PAGE)))).otherwise(1.0).cast("int")


def filter_parse(requests: DataFrame) -> DataFrame:
    """Raw string parameters (``category`` and ``focus`` are arrays) to filters: unknown
    values become the default, numbers are bounded, lists hold known values once."""
    kind = _allowed("result_type", RESULT_TYPES, "programs")
    chosen = lambda c, options: F.coalesce(F.array_intersect(c, F.array(*map(F.lit, options))), F.array().cast("array<string>"))
    amount = _number(F.col("min_award"))
    program_page = _page(F.col("program_page"), F.when(kind != "leads", F.col("page")))
    lead_page = _page(F.col("lead_page"), F.col("candidate_page"), F.when(kind == "leads", F.col("page")))
    return requests.select(
        "id",
        F.substring(F.trim(F.coalesce("q", F.lit(""))), 1, LONGEST_Q).alias("q"),
        chosen("category", CATEGORIES).alias("categories"),
        F.coalesce(F.get(chosen("category", CATEGORIES), F.lit(0)), F.lit("")).alias("category"),
        chosen("focus", tuple(FOCUS)).alias("focus"),
        _allowed("applicant", APPLICANT_TYPES).alias("applicant"),
        _allowed("location", LOCATIONS).alias("location"),
        _allowed("status", STATUSES).alias("status"),
        _allowed("freshness", FRESHNESS).alias("freshness"),
        _allowed("sort", SORTS, "recommended").alias("sort"),
        kind.alias("result_type"),
        F.when((amount >= 0) & (amount < float("inf")), F.least(amount, F.lit(MOST_MONEY))).otherwise(0.0).alias("min_award"),
        program_page.alias("program_page"),
        lead_page.alias("lead_page"),
        F.when(kind == "leads", lead_page).otherwise(program_page).alias("page"),
        F.coalesce(F.col("saved") == "1", F.lit(False)).alias("saved"),
    )
