"""Streams run over files until none is left, in one go and after a restart."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from fundcat.operators import reports
from fundcat.streaming import monitor as M
from fundcat.streaming import trailing as T
from fundcat.streaming.bounded import run_available

AT = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp")


def test_counts_fall_without_events(spark):
    rows = [("a", AT + dt.timedelta(minutes=m)) for m in (0, 59, 60, 61)] + [("b", AT)]
    got = {(r.key, r.at): (r.last_1d, r.last_7d, r.last_30d) for r in T.trailing_hours(_events(spark, rows)).collect()}
    h, d = dt.timedelta(hours=1), dt.timedelta(days=1)
    assert [got["a", AT + x] for x in (h, 2 * h, h + d, 2 * h + d, h + 7 * d, 2 * h + 7 * d, h + 30 * d, 2 * h + 30 * d)] == [(2, 2, 2), (4, 4, 4), (2, 4, 4), (0, 4, 4), (0, 2, 4), (0, 0, 4), (0, 0, 2), (0, 0, 0)]
    assert sum(k == "b" for k, _ in got) == 4
    assert T.trailing_hours(_events(spark, rows), "2024-01-01 02:00:00").count() == 2


def test_trailing_stream_is_its_twin_at_every_hour(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted([(rng.choice("abc"), AT + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))) for _ in range(400)] + [("z", AT + dt.timedelta(days=45))], key=lambda r: r[1])
    folder, schema = str(tmp_path / "s"), "key string, ts timestamp"
    for at in range(0, len(rows), 150):  # each part is a run that goes on with the last one's state
        _events(spark, rows[at : at + 150]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run_available(spark, str(tmp_path / "in"), schema, lambda e: T.trailing_stream(e, "1 minute"), folder)
    last = max(r[1] for r in rows) - dt.timedelta(minutes=1)
    want = sorted(map(tuple, T.trailing_hours(_events(spark, rows)).where(F.col("at") < F.lit(last)).collect()))
    assert sorted(map(tuple, got.where(F.col("at") < F.lit(last)).collect())) == want and len(want) > 1000


def test_snapshots_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randrange(9)}", AT + dt.timedelta(hours=i), f"h{rng.randrange(2)}") for i in range(300)]
    schema = "id long, url string, fetched_at timestamp, content_hash string"
    for at in range(0, 300, 100):
        spark.createDataFrame(rows[at : at + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run_available(spark, str(tmp_path / "in"), schema, M.snapshot_stream, str(tmp_path / "s"))
    again = run_available(spark, str(tmp_path / "in"), schema, M.snapshot_stream, str(tmp_path / "s"))
    last, want = {}, []
    for i, url, _, h in rows:
        if last.get(url) != h:
            want.append(i)
        last[url] = h
    assert sorted(r.id for r in got.collect()) == want == sorted(r.id for r in again.collect())
    assert hasattr(reports, "snapshot_changes")


def test_rows_due_at_once_are_those_of_each_hour():
    hours = np.array([0, 7200])
    at, sums = T.due_rows(hours, np.array([2, 3]), -1, 7 * 86400 + 3600)
    assert at.tolist() == [3600, 10800, 3600 + 86400, 10800 + 86400, 3600 + 7 * 86400]
    assert sums.tolist() == [[2, 2, 2], [5, 5, 5], [3, 5, 5], [0, 5, 5], [0, 3, 5]]
    assert T.due_rows(hours, np.array([2, 3]), 3600, 10800)[0].tolist() == [10800]


def test_snapshot_state_is_held_by_group_and_forgotten_by_url(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "GROUPS", 2)
    schema = "id long, url string, fetched_at timestamp, content_hash string"
    day = lambda n: AT + dt.timedelta(days=n)
    parts = [[(i, f"u{i}", day(0), "h") for i in range(40)], [(50, "u0", day(20), "h")], [(60, "u1", day(45), "h"), (61, "u2", day(45), None)], [(70, "u0", day(46), "h"), (71, "u3", day(46), "h"), (72, "u2", day(46), None)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run_available(spark, str(tmp_path / "in"), schema, M.snapshot_stream, str(tmp_path / "s"))
    # u1 was there with the time that made the others old; u3 had gone by then, u0 was seen since.
    assert sorted(r.id for r in got.collect()) == [*range(40), 61, 71]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in _progress(spark, tmp_path)]
    assert held and max(held) <= 2


def _progress(spark, tmp_path):
    source = spark.readStream.schema("id long, url string, fetched_at timestamp, content_hash string").parquet(str(tmp_path / "in"))
    run = M.snapshot_stream(source).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    return run.recentProgress
