"""Streams against their batch twins."""

import datetime as dt

from fundcat.streaming import monitor as M


def _stream(spark, df, folder, run, name, mode):
    df.coalesce(1).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = run(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def _visits(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    rows = [(i, at(i // 3), f"s{i % 2}", f"o{i % 5}", at(i // 3, i * 7 % 60), ("read", "failed", "discontinued", "failed", "reopened", "failed")[i * 5 % 6]) for i in range(60)]
    return spark.createDataFrame(rows, "id long, run timestamp, source_id string, opportunity_id string, ts timestamp, outcome string")


def test_monitor_stream_ends_as_its_twin(spark, tmp_path):
    visits = _visits(spark)
    got = _stream(spark, visits, tmp_path, M.monitor_fold_stream, "folded", "update")
    assert sorted(map(tuple, got.select("opportunity_id", "state", "failures", "last_success", "checks").collect()), key=str) == sorted(map(tuple, M.monitor_fold(visits).select("opportunity_id", "state", "failures", "last_success", "checks").collect()), key=str)


def test_visit_stream_passes_each_key_once(spark, tmp_path):
    visits = _visits(spark).unionByName(_visits(spark))
    got = _stream(spark, visits, tmp_path, lambda v: M.visit_dedup(v).select("run", "source_id", "opportunity_id"), "passed", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.visit_dedup(visits).select("run", "source_id", "opportunity_id").collect()))


def test_snapshot_stream_passes_changed_pages(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, f"u{i % 2}", at + dt.timedelta(hours=i), f"h{i // 4 % 2}") for i in range(16)]
    df = spark.createDataFrame(rows, "id long, url string, fetched_at timestamp, content_hash string")
    got = _stream(spark, df, tmp_path, M.snapshot_stream, "changed", "append")
    assert sorted(r.id for r in got.collect()) == [0, 1, 4, 5, 8, 9, 12, 13]
