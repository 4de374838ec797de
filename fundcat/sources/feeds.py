"""Official feeds as JSON rows: federal and state grant records, example awards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundcat.functions import exprs as X
from fundcat.schema import AS_OF

FEDERAL = "id long, opportunityTitle string, ost string, synopsis struct<agencyName:string, fundingInstruments:array<struct<id:string>>, applicantTypes:array<struct<id:string>>, awardFloor:string, awardCeiling:string, responseDateStr:string, postingDateStr:string>"
STATE = "PortalID long, Title string, Type string, Status string, AgencyDept string, ApplicantType string, Geography string, EstAmounts string, ApplicationDeadline string, OpenDate string"
AWARDS = "results array<struct<appl_id:long, opportunity_number:string, project_title:string, fiscal_year:int>>"
#: The feeds' codes and labels of applicants.
FEDERAL_APPLICANTS = {"06": "organization", "6": "organization", "20": "organization", "21": "individual", "22": "business", "23": "business", "12": "nonprofit", "13": "nonprofit"}
STATE_APPLICANTS = {"Individual": "individual", "Business": "business", "Nonprofit": "nonprofit"}
STATEWIDE = r"(?i)^(?:statewide|throughout california|all of california|california statewide)[. ]*$"
_MONEY = r"\$[\d,.]+"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _kinds(codes: Column, values: dict[str, str]) -> Column:
    known = F.transform(codes, lambda c: _lookup(values, F.trim(c)))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(known))), ",")


def _amount(text: Column) -> Column:
    """A plain number of at most two decimals, dollar signs and commas left out."""
    digits = F.regexp_replace(text, r"[$,]", "")
    return F.when(digits.rlike(r"^\d+(\.\d{1,2})?$"), digits.try_cast("double"))


def _dated(status: Column, opens: Column, deadline: Column, as_of: str) -> Column:
    """An open record that starts later is upcoming; one whose deadline passed is closed."""
    today = F.to_date(X.now(as_of))
    return F.when((status == "open") & (opens > today), "upcoming").when((status == "open") & (deadline < today), "closed").otherwise(status)


_titled = lambda: F.length("title").between(8, 250)


def feed_federal(raw: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Records whose instruments include a grant. Malformed JSON and records without a
    synopsis or a usable title give no row; a forecast's opening date is not kept."""
    r = raw.select(F.from_json("raw", FEDERAL).alias("r")).select("r.*", "r.synopsis.*")
    r = r.where(F.exists("fundingInstruments", lambda i: i["id"] == "G")).withColumn("title", F.trim("opportunityTitle"))
    r = r.withColumns({"deadline": X.source_date(F.col("responseDateStr")), "posted": X.source_date(F.col("postingDateStr")), "was": F.lower("ost")})
    status = _lookup({"posted": "open", "forecasted": "upcoming", "closed": "closed", "archived": "closed"}, F.col("was"))
    return r.where(_titled() & F.col("id").isNotNull()).select(
        F.col("id").cast("string").alias("id"),
        "title",
        F.col("agencyName").alias("funder"),
        _dated(status, F.col("posted"), F.col("deadline"), as_of).alias("status"),
        "deadline",
        F.when(F.col("was") != "forecasted", F.col("posted")).alias("opens"),
        _amount(F.col("awardFloor")).alias("minimum"),
        _amount(F.col("awardCeiling")).alias("maximum"),
        _kinds(F.col("applicantTypes.id"), FEDERAL_APPLICANTS).alias("applicants"),
    )


def feed_state(raw: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Records of type grant. A range whose ends are out of order gives no amounts."""
    r = raw.select(F.from_json("raw", STATE).alias("r")).select("r.*").where(F.lower(F.trim("Type")) == "grant").withColumn("title", F.trim("Title"))
    amounts = F.col("EstAmounts")
    low, high = (_amount(F.regexp_extract(amounts, rf"(?i)^Between\s+({_MONEY})\s+and\s+({_MONEY})$", i)) for i in (1, 2))
    one = F.when(amounts.rlike(rf"^{_MONEY}$"), _amount(amounts))
    status = F.lower("Status")
    r = r.withColumns({"deadline": X.source_date(F.col("ApplicationDeadline")), "posted": X.source_date(F.col("OpenDate"))})
    known = F.when(status == "active", "open").when(status == "closed", "closed")
    return r.where(_titled() & F.col("PortalID").isNotNull()).select(
        F.col("PortalID").cast("string").alias("id"),
        "title",
        F.col("AgencyDept").alias("funder"),
        _dated(known, F.col("posted"), F.col("deadline"), as_of).alias("status"),
        "deadline",
        F.coalesce(F.trim("ApplicationDeadline").rlike("(?i)^(ongoing|rolling)$"), F.lit(False)).alias("rolling"),
        F.coalesce(F.when(low <= high, low), one).alias("minimum"),
        F.coalesce(F.when(low <= high, high), one).alias("maximum"),
        _kinds(F.split("ApplicantType", ";"), STATE_APPLICANTS).alias("applicants"),
        F.when(F.trim("Geography").rlike(STATEWIDE), "California").alias("state"),
    )


def award_examples(raw: DataFrame, programs: DataFrame, most: int = 10) -> DataFrame:
    """``programs``: ``(opportunity_id, identifier)``. At most ``most`` awards whose
    official number is the program's, in the feed's order; never by title."""
    awards = raw.select("n", F.posexplode(F.from_json("raw", AWARDS)["results"]).alias("place", "a")).select("n", "place", "a.*")
    first = Window.partitionBy("opportunity_number").orderBy("n", "place")
    # Numbers first: each keeps at most ``most`` awards before it meets its programs.
    awards = awards.where(F.col("appl_id").isNotNull()).withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most)
    return programs.join(awards, F.col("identifier") == F.col("opportunity_number")).select("opportunity_id", "turn", F.col("appl_id"), F.col("project_title").alias("title"), F.col("fiscal_year").alias("year"))
