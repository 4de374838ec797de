"""How queries are registered, and pieces that their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.fixtures import Catalog, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, texts: tuple[str, ...] = ()):
    """Register a query. ``texts``: dates and nullable numbers that both sides give as
    text, so that no client's conversion of nulls and dates comes between them."""

    def put(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in texts})
        if sql:
            own = sql.strip()
            views = with_views(own + " ").removesuffix(own + " ").strip()
            full = f"{views}, {own[5:]}" if views and own.startswith("with ") else f"{views} {own}"
            cast = ", ".join(f"cast({c} as varchar) as {c}" for c in texts)
            ORACLES[name] = f"select * replace ({cast}) from ({full})" if texts else full
        return f

    return put


TODAY = "date '2024-01-31'"
NOW = "timestamp '2024-01-31 00:00:00'"
VISIBLE = "not o.is_demo and o.merged_into is null and o.publication_state = 'published' and o.verification_status <> 'archived'"
KEY = "regexp_replace(regexp_replace(regexp_replace(lower(name), '\\b(19|20)[0-9]{2}([-–][0-9]{2,4})?\\b', '', 'g'), '\\b(the|usda|nea|nsf|spencer)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"
HOST = "regexp_replace(regexp_extract({0}, '^https?://([^/?#]+)', 1), '^www\\.', '')"
