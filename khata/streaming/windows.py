"""Streams of events: alert windows, a token bucket per user, and late revisions, with watermarks.

The work the batch queries do over tables, on unbounded input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from khata.operators.quality import ERROR_SHARE, REQUEST_FLOOR


def timed(events: DataFrame, late: str) -> DataFrame:
    """events with ts as an instant and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def alert_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Five-minute windows that are final: requests, errors and whether the error share passes its bound."""
    return (
        timed(events, late).groupBy(F.window("ts", "5 minutes").alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(F.col("w.start").alias("start"), "requests", "errors", ((F.col("requests") >= REQUEST_FLOOR) & (F.col("errors") > ERROR_SHARE * F.col("requests"))).alias("alert"))
    )


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end and events."""
    return timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest_revisions(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """The first copy of each revision of a cell; repeats within the watermark are dropped."""
    return timed(facts, late).dropDuplicatesWithinWatermark(["fact_key", "amount"])


def limited_stream(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """user_id, event_id, allowed: a token bucket per user that refills by event time."""

    def take(key, batches, state: GroupState):
        tokens, last = state.get if state.exists else (burst, None)
        for rows in batches:
            rows = rows.sort_values(["ts", "event_id"])
            allowed = []
            for ts in rows["ts"]:
                now = ts.timestamp()
                if last is not None:
                    tokens = min(burst, tokens + max(0.0, now - last) * rate)
                last = now if last is None else max(last, now)
                allowed.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})
        state.update((float(tokens), last))

    return events.groupBy("user_id").applyInPandasWithState(take, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
