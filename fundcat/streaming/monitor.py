"""State machines over events, as streaming queries and as batch twins.

A twin gives the rows that the stream has given once all events have passed;
``trailing_activity`` has the batch form alone. Streams hold a key's state until its
window, or a month without events, has passed by event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_runs(visits: DataFrame) -> DataFrame:
    """Events per hour; the same text serves a stream, which closes an hour two hours
    later."""
    rows = visits.withWatermark("ts", "2 hours") if visits.isStreaming else visits
    return rows.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("run"), "events")


def visit_dedup(visits: DataFrame) -> DataFrame:
    """One visit per run, source and program: the first by time and id; in a stream,
    the first that arrives within a day."""
    key = ["run", "source_id", "opportunity_id"]
    if visits.isStreaming:
        return visits.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(key)
    return visits.groupBy(*key).agg(F.min(F.struct("ts", "id")).alias("v")).select(*key, "v.id")


def trailing_activity(visits: DataFrame) -> DataFrame:
    """Per event: its program's events in the trailing day, week and month, itself
    included. Range windows over one key."""
    seconds = F.unix_seconds("ts")
    back = lambda days: Window.partitionBy("opportunity_id").orderBy(seconds).rangeBetween(-86400 * days, 0)
    return visits.select("id", "opportunity_id", *[F.count(F.lit(1)).over(back(d)).alias(f"last_{d}d") for d in (1, 7, 30)])


def monitor_fold(visits: DataFrame) -> DataFrame:
    """Per program: its state after all events in order, and failures in a row at the
    end. One event per run counts, the first. In batch the state is the last signal, and
    the failures are those after the last success, so no row needs the one before."""
    first = visits.groupBy("opportunity_id", "run").agg(F.min(F.struct("ts", "id", "outcome")).alias("v")).select("opportunity_id", "v.ts", "v.id", "v.outcome")
    signal = F.when(F.col("outcome") == "discontinued", "discontinued").when(F.col("outcome") == "reopened", "active")
    at = F.struct("ts", "id")
    per = first.groupBy("opportunity_id").agg(
        F.max(F.when(signal.isNotNull(), F.struct("ts", "id", signal.alias("state")))).alias("s"),
        F.max(F.when(F.col("outcome") != "failed", at)).alias("ok"),
        F.count(F.lit(1)).alias("checks"),
    )
    fails = first.where("outcome = 'failed'").join(per.select("opportunity_id", "ok"), "opportunity_id").where("ok is null or struct(ts, id) > ok").groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("failures"))
    return per.join(fails, "opportunity_id", "left").select("opportunity_id", F.coalesce("s.state", F.lit("active")).alias("state"), F.coalesce("failures", F.lit(0)).alias("failures"), F.col("ok.ts").alias("last_success"), "checks")


def _limit(times: Iterator[float], limit: int, seconds: int, start: float | None, used: int) -> Iterator[tuple[float, int, bool]]:
    for t in times:
        if start is None or t >= start + seconds:
            start, used = t, 0
        used += 1
        yield start, used, used <= limit


def rate_limit(attempts: DataFrame, limit: int = 3, seconds: int = 86400) -> DataFrame:
    """Per attempt, whether it is allowed: a window starts at the first attempt after
    the last has run out. Each key's attempts are read once, in order, and only the
    window's start and count are held; rows come in time order from the shuffle."""
    schema = "id long, key long, used int, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, used = None, None, 0
        for b in batches:
            out = []
            for i, k, t in zip(b["id"], b["key"], b["t"], strict=True):
                if k != key:
                    key, start, used = k, None, 0
                start, used, ok = next(_limit(iter([t]), limit, seconds, start, used))
                out.append((i, k, used, ok))
            yield pd.DataFrame(out, columns=["id", "key", "used", "allowed"])

    ordered = attempts.select("id", "key", F.unix_micros("ts").alias("t0")).repartition("key").sortWithinPartitions("key", "t0", "id")
    return ordered.select("id", "key", (F.col("t0") / 1e6).alias("t")).mapInPandas(run, schema)


#: Days without events after which a stream forgets a key.
FORGET = 30


def _keep(state, until_ms: int) -> None:
    """Hold the state until that event time, or until the watermark moves on."""
    state.setTimeoutTimestamp(max(until_ms, state.getCurrentWatermarkMs() + 1))


def rate_limit_stream(attempts: DataFrame, limit: int = 3, seconds: int = 86400, late: str = "1 hour") -> DataFrame:
    """The stream of ``rate_limit``: window start and count are the key's state, which
    goes when the window has run out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for i, t in zip(rows["id"], rows["ts"], strict=True):
            start, used, ok = next(_limit(iter([t.timestamp()]), limit, seconds, start, used))
            out.append((i, key[0], used, ok))
        state.update((start, used))
        _keep(state, int((start + seconds) * 1000))
        yield pd.DataFrame(out, columns=["id", "key", "used", "allowed"])

    rows = attempts.withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(fold, "id long, key long, used int, allowed boolean", "start double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def monitor_fold_stream(visits: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream of ``monitor_fold``, in update mode: a program's row whenever visits of
    it arrive. Visits of a program come in time order across batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        signal, failures, success, checks, run = state.get if state.exists else ("active", 0, None, 0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for this, outcome, t in zip(rows["run"], rows["outcome"], rows["ts"], strict=True):
            if run is not None and this.timestamp() <= run:
                continue
            run, checks = this.timestamp(), checks + 1
            failures = failures + 1 if outcome == "failed" else 0
            success = success if outcome == "failed" else t.timestamp()
            signal = {"discontinued": "discontinued", "reopened": "active"}.get(outcome, signal)
        state.update((signal, failures, success, checks, run))
        _keep(state, int(rows["ts"].max().timestamp() * 1000) + FORGET * 86_400_000)
        yield pd.DataFrame({"opportunity_id": [key[0]], "state": [signal], "failures": [failures], "last_success": [success], "checks": [checks]})

    out = "opportunity_id string, state string, failures long, last_success double, checks long"
    rows = visits.withWatermark("ts", late).groupBy("opportunity_id").applyInPandasWithState(fold, out, "state string, failures int, success double, checks int, run double", "update", GroupStateTimeout.EventTimeTimeout)
    return rows.withColumn("last_success", F.timestamp_seconds("last_success"))


#: Groups of urls whose state is held together. Every group costs a call, whatever it
#: holds, so their number is fixed and they grow with the urls.
GROUPS = 1 << 14


def snapshot_stream(snaps: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream of changed pages: a snapshot passes when its hash is not the last one
    seen for the url. Each url is forgotten for itself, in the batch in which its own time
    has passed, unless that batch has it; its group's timer is that of the next url due."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        urls, hashes, until = state.get if state.exists else ((), (), ())
        last = dict(zip(urls, zip(hashes, until, strict=True), strict=True))
        now, out, met = state.getCurrentWatermarkMs(), [], {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["fetched_at", "id"])
            times = rows["fetched_at"].astype("datetime64[ms]").astype("int64")
            for i, url, h, t in zip(rows["id"], rows["url"], rows["content_hash"], times, strict=True):
                if url not in last or last[url][0] != h:
                    out.append((i, url, h))
                last[url] = met[url] = (h, max(t + FORGET * 86_400_000, now + 1))
        last = {url: s for url, s in last.items() if url in met or s[1] >= now}
        if last:
            state.update((list(last), [h for h, _ in last.values()], [u for _, u in last.values()]))
            _keep(state, min(u for _, u in last.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["id", "url", "content_hash"])

    rows = snaps.withWatermark("fetched_at", late).withColumn("group", F.pmod(F.xxhash64("url"), F.lit(GROUPS)))
    return rows.groupBy("group").applyInPandasWithState(fold, "id long, url string, content_hash string", "urls array<string>, hashes array<string>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
