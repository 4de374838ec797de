"""Registered streaming queries: run over what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundcat.plans.base import query
from fundcat.streaming import monitor as M
from fundcat.streaming import trailing as T
from fundcat.streaming.bounded import run_available
from fundcat.tables import new_folder


@query("snapshot_stream", "select id, url, content_hash from (select *, row_number() over w as n, lag(content_hash) over w as h from crawl_snapshots window w as (partition by url order by fetched_at, id)) where n = 1 or content_hash is distinct from h")
def snapshot_stream(c):
    snaps = c["crawl_snapshots"].select("id", "url", "fetched_at", "content_hash")
    source = new_folder(c.spark, "snapshots")
    snaps.write.parquet(source)
    return run_available(c.spark, source, snaps.schema, M.snapshot_stream)


#: Rows that are due after the last hour before the watermark are not yet there.
_UNTIL = "(select max(cast(ts as timestamp)) - interval 2 hour from events)"


@query(
    "trailing_activity_stream",
    f"""with h as (select 'o' || cast(user_id as varchar) as key, date_trunc('hour', cast(ts as timestamp)) as hour, count(*) as n from events group by 1, 2),
 m as (select key, hour + interval 1 hour + to_days(d) as due, case when d = 0 then n when d = 1 then -n else 0 end as a, case when d = 0 then n when d = 7 then -n else 0 end as b, case when d = 0 then n when d = 30 then -n else 0 end as c from h cross join (values (0), (1), (7), (30)) as x(d)), s as (select key, due, sum(a) as a, sum(b) as b, sum(c) as c from m group by 1, 2),
 w as (select key, due, sum(a) over (partition by key order by due) as a, sum(b) over (partition by key order by due) as b, sum(c) over (partition by key order by due) as c from s)
 select key, strftime(due, '%Y-%m-%d %H:%M:%S') as "at", cast(a as bigint) as last_1d, cast(b as bigint) as last_7d, cast(c as bigint) as last_30d from w where due < {_UNTIL}""",
)
def trailing_activity_stream(c):
    events = c["events"]
    # A pattern, as the table may be one file and a stream wants a folder otherwise.
    flow = lambda e: T.trailing_stream(e.select(F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts")))
    rows = run_available(c.spark, f"{c.sf_dir}/events.parquet*", events.schema, flow)
    until = events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 2 hours")).alias("until"))
    return rows.join(until).where("at < until").select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "last_1d", "last_7d", "last_30d")
