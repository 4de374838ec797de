"""Every registered catalog query against its SQL, and values of single functions."""

import datetime as dt
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from fundcat.functions import exprs as X
from fundcat.functions.urls import canonical, safe
from fundcat.plans.registry import ORACLES, QUERIES
from fundcat.sources.pages import parse
from fundcat.streaming import monitor as M

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (dt.datetime, dt.date, str, bool)):
        return str(v)[:19]
    return f"{float(v):.6f}"


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_urls():
    assert canonical("https://Example.org/a//?utm_source=x&b=2&a=1#top") == "https://example.org/a?a=1&b=2"
    assert canonical("https://example.org/") == "https://example.org/"
    for bad in ("http://example.org", "https://u:p@example.org", "https://example.org:8443/", "https://localhost/", "https://10.0.0.1/", "https://a.internal/", "https://224.0.0.1/", None, "", "https://[::1"):
        assert not safe(bad) and canonical(bad) is None
    assert safe("https://8.8.8.8/")


def test_scalars(spark):
    from pyspark.sql import functions as F

    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(X.source_date(F.lit("2024-02-30"))) is None
    assert one(X.source_date(F.lit("2/29/2024"))) == dt.date(2024, 2, 29)
    assert one(X.parse_amount(F.lit("up to $1,234.50"))) == 1234.5
    assert one(X.parse_amount(F.lit("$2.5 million"))) == 2_500_000
    assert one(X.parse_amount(F.lit("none"))) is None
    assert one(X.program_key(F.lit("The Example Grant 2024-25"))) == "examplegrant"
    assert one(X.words_in(F.lit("  a b\n c "))) == 3 and one(X.words_in(F.lit(" "))) == 0
    assert one(X.schedule_day(F.to_timestamp(F.lit("2024-03-10 09:59:00")))) == dt.date(2024, 3, 9)
    assert one(X.schedule_day(F.to_timestamp(F.lit("2024-03-10 10:00:00")))) == dt.date(2024, 3, 10)
    assert "555" not in one(X.scrub(F.lit("call 212-555-0100 or a@b.org, 10001")))
    assert one(F.array_join(X.focus_tags(F.lit("Rural women farmers")), ",")) == "rural,women"


def test_page_roles(spark):
    from pyspark.sql import functions as F

    from fundcat.functions import roles as P

    body = "The program supports artists. Apply by May."
    cases = [
        ("Small Grants Program", "/p", "Apply now", "program"), ("What is a grant?", "/p", "", "supporting"), ("Grant FAQ", "/p", "", "faq"), ("Application guidelines", "/p", "", "guidelines"),
        ("Grant recipients", "/p", "", "announcement"), ("Apply", "/x/apply/", "", "application"), ("Frequently asked questions?", "/p", "", "supporting"), ("Webinar: grants", "/p", body, "supporting"),
        ("Top 10 grants for artists", "/p", body, "directory"), ("“River Fund 2024”", "/p", body, "program"), ("River Fund", "/p", "Nothing to see", "ambiguous"), ("Managing your grant", "/p", body, "supporting"),
        ("River Fund", "/docs/form.pdf", body, "supporting"), ("All grants", "/p", body, "directory"), ("River Fund", "/faq/", body, "faq"), (None, "/p", None, "ambiguous"),
    ]
    rows = spark.createDataFrame([(i, t, "https://x.org" + p, b, r) for i, (t, p, b, r) in enumerate(cases)], "i int, title string, url string, body string, role string")
    got = rows.withColumn("got", P.page_role(F.col("title"), F.col("url"), F.col("body"))).collect()
    assert [(r.title, r.got) for r in got] == [(r.title, r.role) for r in got]
    own = spark.createDataFrame([("Technical Assistance Awards", "https://www.rd.usda.gov/x", "A list of entities that received USDA funding"), ("Research-Practice Partnerships: more", "https://www.spencer.org/grant_types/research-practice-partnerships", "Research-Practice Partnership (RPP) Grants Program")], "title string, url string, body string")
    assert [r[0] for r in own.select(P.page_role(F.col("title"), F.col("url"), F.col("body"))).collect()] == ["announcement", "program"]


def test_merge_closure_stops_at_overlong_chains_and_cycles(spark):
    from fundcat.operators import catalog as C

    links = [(f"a{i}", f"a{i + 1}") for i in range(25)] + [("a25", None), ("x", "y"), ("y", "x"), ("z", "z")]
    rows = spark.createDataFrame(links, "id string, merged_into string")
    got = {r.id: (r.target, r.hops) for r in C.merge_closure(rows).collect()}
    assert all(got[f"a{i}"] == (("a25", 25 - i) if i >= 5 else (None, None)) for i in range(25)) and all(got[i] == (None, None) for i in "xyz")
    family = dict(C.merge_families(rows).collect())
    assert family["a25"] == "a25" == family["a5"] and "a4" not in family and "x" not in family


def test_page():
    html = "<html><title>T</title><nav>menu</nav><body><h1>Art <b>Fund</b></h1><p>We support artists in every region.<script>x()</script><a href='/a#b'>a</a><a href='/a'>b</a></body>"
    title, text, links = parse("https://example.org/x", html)
    assert title == "Art Fund" and "menu" not in text and "x()" not in text and links == ["https://example.org/a"]
    assert parse("https://example.org", "<p>short</p>") is None and parse(None, None) is None


def test_rate_limit_and_its_stream(spark, tmp_path):
    events = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:10"), (3, 1, "2024-01-01 00:00:20"), (4, 1, "2024-01-01 00:01:05"), (5, 2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(events, "id long, key long, ts string").selectExpr("id", "key", "cast(ts as timestamp) ts")
    batch = M.rate_limit(df, 2, 60).toPandas().sort_values("id").values.tolist()
    assert batch == [[1, 1, 1, True], [2, 1, 2, True], [3, 1, 3, False], [4, 1, 1, True], [5, 2, 1, True]]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = M.rate_limit_stream(stream, 2, 60).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("limits").toPandas().sort_values("id").values.tolist() == batch


def test_entry_works_without_the_training_operators(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(r.status == "open" and r.maximum_award >= 905 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())
