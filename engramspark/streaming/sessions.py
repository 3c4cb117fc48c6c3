"""Sessions as streams: buffers with a sliding time to live, gaps, sequences, cursors and the failure ledger.

Everything that plain aggregates over event time express is written so, and serves batch and stream alike; the message
buffer, which hands out the last messages and forgets idle sessions, is a stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import DEFAULT, Config


def sessions(log: DataFrame, key: str, gap: str = "1 hour") -> DataFrame:
    """key, started, ended and events of each session: events less than ``gap`` apart are one. Batch or stream; a stream wants a watermark."""
    by = log.groupBy(F.col(key).alias("key"), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return by.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def since(rows: DataFrame, created: str, cursor: str) -> DataFrame:
    """Rows created after the cursor, and those whose time can't be read."""
    at = F.try_to_timestamp(F.col(created))
    return rows.where(at.isNull() | (at > F.lit(cursor).cast("timestamp")))


def ledger(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """How often each key was parked (failed ``park_after`` times without a success between), and its failures."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    rows = log.select("key", failed.alias("failed"), F.row_number().over(w).alias("n"))
    before = Window.partitionBy("key").orderBy("n")
    reset = F.coalesce(F.max(F.when(~F.col("failed"), F.col("n"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    streak = F.count_if("failed").over(Window.partitionBy("key", "reset").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    told = rows.withColumn("reset", reset).withColumn("streak", streak)
    return told.groupBy("key").agg(F.count_if(F.col("failed") & (F.col("streak") == config.park_after)).alias("parked_times"), F.count_if("failed").alias("attempts"))


def deduplicated(stream: DataFrame, keys: list[str], gap: str = "5 seconds", time: str = "ts") -> DataFrame:
    """One row per signature within the gap; the gap is the stream's watermark."""
    return stream.withWatermark(time, gap).dropDuplicatesWithinWatermark(keys)


def buffered(stream: DataFrame, keep: int = 10, config: Config = DEFAULT) -> DataFrame:
    """The message buffer of each session (session_id, ts, content): after every batch the count and the last ``keep`` messages; a session idle for the time to live is told as expired and forgotten.

    State of a session is its count and at most ``keep`` messages.
    """
    out = "session_id string, count long, last array<string>, expired boolean"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last, _ = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "count": [n], "last": [list(last)], "expired": [True]})
            return
        n, last, latest = state.get if state.exists else (0, [], 0)
        last = list(last)
        for g in frames:
            g = g.sort_values("ts")
            n += len(g)
            last = [*last, *g["content"].fillna("").tolist()][-keep:]
            latest = max(latest, int(g["ts"].max().timestamp() * 1000))
        state.update((n, last, latest))
        due = latest + config.session_ttl * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "count": [n], "last": [last], "expired": [False]})

    return stream.groupBy("session_id").applyInPandasWithState(update, out, "count long, last array<string>, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def retry_delay(attempt: int, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the next attempt, doubled from attempt to attempt up to a bound; jitter is the caller's."""
    return min(base * 2**attempt, most)
