"""The filters of the unified search, by values."""

from pyspark.sql import functions as F

from fundcat.operators import search as S

ROW = "id long, title string, summary string, url string, since timestamp, categories array<string>"


def test_rows_without_facts_answer_no_search_for_facts(spark):
    rows = spark.createDataFrame([(1, "a", "b", "https://a.org/x", None, ["Music"]), (2, "c", "d", "https://a.org/y", None, [])], ROW)
    cases = [
        (S.Wish(), ["1", "2"]), (S.Wish(status="unknown"), ["1", "2"]), (S.Wish(status="open"), []), (S.Wish(min_award=1), []),
        (S.Wish(categories=("Music", "Film")), ["1"]), (S.Wish(categories=("Film",)), []),
    ]
    for wish, want in cases:
        got = S._other(rows, "lead", F.lit("program"), wish)
        assert sorted(r.id for r in got.collect()) == want
    assert [r.categories for r in S._other(rows.drop("categories"), "external", F.lit("program"), S.Wish()).collect()] == [[], []]
