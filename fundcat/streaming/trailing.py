"""Trailing counts that fall as time passes, without an event.

A key's events are counted by hour. At the end of an hour its events enter the trailing
day, week and month, and one, seven and thirty days later they leave them: a row is due at
each of these times, in the batch form and in the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAYS = 3600, (1, 7, 30)
SCHEMA = "key string, at timestamp, last_1d long, last_7d long, last_30d long"


def trailing_hours(events: DataFrame, until: str | None = None) -> DataFrame:
    """``events(key, ts)`` -> ``(key, at, last_1d, last_7d, last_30d)`` at every full hour at
    which events enter or leave one of the counts, before ``until``. Events of an hour are
    added up first, so a key's sequence is as long as its hours, not its events."""
    hours = events.groupBy("key", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    start = F.unix_seconds("hour") + HOUR
    gone = lambda d, n: F.when(F.lit(d) == n, -F.col("n")).otherwise(0).cast("long")
    steps = [F.struct(start.alias("at"), *[F.col("n").alias(f"d{d}") for d in DAYS])]
    steps += [F.struct((start + 86400 * d).alias("at"), *[gone(d, e).alias(f"d{e}") for e in DAYS]) for d in DAYS]
    moves = hours.select("key", F.explode(F.array(*steps)).alias("m")).groupBy("key", "m.at").agg(*[F.sum(f"m.d{d}").alias(f"d{d}") for d in DAYS])
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.select("key", F.timestamp_seconds("at").alias("at"), *[F.sum(f"d{d}").over(upto).alias(f"last_{d}d") for d in DAYS])
    return rows.where(F.col("at") < F.to_timestamp(F.lit(until))) if until else rows


def due_rows(hours: np.ndarray, counts: np.ndarray, after: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Times after ``after`` and up to ``upto``, in seconds, at which one of the sorted
    ``hours`` enters or leaves a count, and the counts then, a column for each of ``DAYS``."""
    at = np.unique((hours[:, None] + HOUR + 86400 * np.array((0, *DAYS))).ravel())
    at = at[(at > after) & (at <= upto)]
    sums = np.concatenate([[0], np.cumsum(counts)])
    before = lambda t: sums[np.searchsorted(hours, t)]
    return at, np.stack([before(at) - before(at - 86400 * d) for d in DAYS], axis=1)


def trailing_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream of ``trailing_hours``: a key's hourly counts as state, at most those of
    thirty days, and one timeout, at the next time that a row is due; it gives all rows that
    are due by then. Rows come once the watermark has passed their time, also when no event
    does; a key without counts has no state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hours, counts, done = state.get if state.exists else ([], [], -1)
        hours, counts = np.array(hours, dtype=np.int64), np.array(counts, dtype=np.int64)
        if not state.hasTimedOut:
            for b in batches:
                if len(b):
                    hours = np.concatenate([hours, b["hour"].to_numpy()])
                    counts = np.concatenate([counts, np.ones(len(b), dtype=np.int64)])
            hours, where = np.unique(hours, return_inverse=True)
            counts = np.bincount(where, weights=counts, minlength=len(hours)).astype(np.int64)
        now = state.getCurrentWatermarkMs() // 1000
        at, sums = due_rows(hours, counts, done, now)
        if len(at):
            done = int(at[-1])
            left = hours + HOUR + 86400 * max(DAYS) > done
            hours, counts = hours[left], counts[left]
            yield pd.DataFrame({"key": key[0], "at": pd.to_datetime(at, unit="s"), **{f"last_{d}d": sums[:, i] for i, d in enumerate(DAYS)}})
        if len(hours):
            state.update((hours.tolist(), counts.tolist(), done))
            due = (hours[:, None] + HOUR + 86400 * np.array((0, *DAYS))).ravel()
            state.setTimeoutTimestamp(max(int(due[due > done].min()) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    rows = events.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", (F.floor(F.unix_seconds("ts") / HOUR) * HOUR).alias("hour"))
    return rows.groupBy("key").applyInPandasWithState(fold, SCHEMA, "hours array<long>, counts array<long>, done long", "append", GroupStateTimeout.EventTimeTimeout)
