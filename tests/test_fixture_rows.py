"""Views take every row of their parent table."""

from fundcat.fixtures import Catalog

SMALL = "/root/testdata/sf0.001"


def test_views_are_whole(spark):
    c = Catalog(spark, SMALL)
    lines, parts = c["lineitem"].count(), c["part"].count()
    assert c["facts"].count() == c["contribution_submissions"].count() == lines
    assert c["facts"].select("field").distinct().count() == 11
    assert {r.cycle for r in c["facts"].select("cycle").distinct().collect()} == {None, "unresolved", "2022", "2023", "2024", "2025"}
    longest = "max(length(q))"
    assert c["search_requests"].selectExpr(longest).first()[0] == c["conversations"].where("role = 'user'").selectExpr("max(length(text))").first()[0]
    for view in ("saved_opportunities", "applications"):
        keys = {int(r[0][1:]) for r in c[view].select("opportunity_id").dropna().distinct().collect()}
        assert max(keys) < parts
