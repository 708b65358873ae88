"""Stateful streams: accepted actions under a sliding limit, and alerts under a cooldown.

Both keep, for each key, only the accepted times that still count, and let event time expire
keys that have gone quiet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limited(events: DataFrame, keys: list[str], ts: str, window_s: int, most: int, late: str = "10 minutes") -> DataFrame:
    """The stream's rows of ``keys`` and ``ts`` that were accepted: fewer than ``most`` accepted
    ones of the key stand within the window before.  Suppressed ones don't extend it."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*keys, ts).schema)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        found = pd.concat(list(frames)).sort_values(ts)
        keep = []
        for now in found[ts].astype("int64").floordiv(1000 if str(found[ts].dtype).startswith("datetime64[ns") else 1):
            times = [t for t in times if t >= now - window_s * 1_000_000]
            keep.append(len(times) < most)
            if keep[-1]:
                times.append(int(now))
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(times[-1] // 1000 + window_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield found[keep][[*keys, ts]]

    timed = events.select(*keys, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return timed.groupBy(*keys).applyInPandasWithState(step, kinds.replace("timestamp_ntz", "timestamp"), "times array<long>", "append", "EventTimeTimeout")


def cooled(alerts: DataFrame, ts: str, hours: int = 1) -> DataFrame:
    """Alerts (title, body, ts): each text at most once an hour, counted from the last one sent."""
    return limited(alerts, ["title", "body"], ts, hours * 3600, 1)


def active_counts(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Reports made in each hour by facility and kind, as a windowed stream."""
    timed = reports.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", "1 hour"), "facility_id", "type").agg(F.count("*").alias("n"))
