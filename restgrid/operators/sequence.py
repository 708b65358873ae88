"""Greedy rules over ordered events of a key, where what was accepted decides what comes next.

Rows are dealt by key, sorted within partitions by Spark, and run through in one pass that holds
one key's state at a time: the accepted times of one window, so memory doesn't grow with a key.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted(events: DataFrame, keys: list[str], order: list[str], micros: str, window_s: float, most: int) -> DataFrame:
    """Adds ``accepted``: fewer than ``most`` events were accepted within the window before.

    ``micros``: event time in microseconds; the window's start is inclusive.
    """
    width = int(window_s * 1_000_000)

    def run(batches):
        key, times = None, deque()
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            out = np.zeros(batch.num_rows, bool)
            for i, (now, *own) in enumerate(zip(batch.column(batch.schema.get_field_index(micros)).to_pylist(), *cols)):
                if own != key:
                    key, times = own, deque()
                while times and times[0] < now - width:
                    times.popleft()
                if len(times) < most:
                    out[i] = True
                    times.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return events.repartition(*keys).sortWithinPartitions(*keys, micros, *order).mapInArrow(run, f"{kinds}, accepted boolean")


class Sliding:
    """At most ``most`` accepted rows within the window before a row; its start counts unless ``open``."""

    inputs: tuple[str, ...] = ()

    def __init__(self, window_s: float, most: int, open: bool = False):
        self.width, self.most, self.open = int(window_s * 1_000_000), most, open

    def start(self) -> list[int]:
        return []

    def step(self, times: list[int], now: int, row) -> str | None:
        """Why the row is refused, or None; accepted rows go into the state."""
        while times and times[0] < now - self.width + self.open:
            times.pop(0)
        if len(times) >= self.most:
            return "limit"
        times.append(now)
        return None

    def reach(self, times: list[int]) -> int:
        """The last time at which the state still says anything."""
        return times[-1] + self.width if times else -1


class ReportRules:
    """Reports at one facility: a user's limit, then the rule against repeats of an active type.
    Only accepted reports use up a limit or stand in another's way; stored ones were accepted."""

    inputs = ("user_id", "type", "_until", "_active", "_stored")

    def __init__(self, window_s: float, most: int):
        self.limit = Sliding(window_s, most)

    def start(self) -> dict:
        return {"users": {}, "until": {}}

    def step(self, state: dict, now: int, row) -> str | None:
        user, kind, until, active, stored = row
        users, ends = state["users"], state["until"]
        times = users.setdefault(str(user), [])
        if not stored:
            while times and times[0] < now - self.limit.width:
                times.pop(0)
            if len(times) >= self.limit.most:
                return "limit"
            if ends.get(str(kind), -1) >= now:
                return "repeat"
        times.append(now)
        if active and until is not None:
            ends[str(kind)] = max(until, ends.get(str(kind), -1))
        if len(users) > 1000:  # users of an hour and more ago say nothing any more
            for u in [u for u, t in users.items() if not t or t[-1] < now - self.limit.width]:
                del users[u]
        return None

    def reach(self, state: dict) -> int:
        return max([-1, *state["until"].values(), *(t[-1] + self.limit.width for t in state["users"].values() if t)])


def with_sessions(events: DataFrame, keys: list[str], micros: str, reach: Column) -> DataFrame:
    """Adds ``_session``: a key's rows up to a time from which nothing before can still have an effect
    (``reach`` of every row is past), so that a long key is several groups.  Found from one row
    for each key and hour."""
    hour = F.floor(F.col(micros) / 3_600_000_000)
    spans = events.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], hour.alias("_hour")).agg(F.min(micros).alias("_low"), F.max(reach).alias("_reach"))
    by = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_hour")
    before = F.max("_reach").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (before < F.col("_low")).cast("long")
    spans = spans.withColumn("_new", new).withColumn("_session", F.sum(F.coalesce("_new", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_low", "_reach", "_new")
    same = hour == F.col("_hour")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return events.join(spans, same).drop("_hour", *[f"_k{i}" for i in range(len(keys))])


def judged(events: DataFrame, keys: list[str], order: list[str], micros: str, machine) -> DataFrame:
    """Adds ``refused``: why a machine refuses a row, or null.  A machine holds one key's state at a time
    and sees the key's rows in order of time, then ``order``."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            cols = [[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names] for names in (keys, machine.inputs)]
            own, given = (zip(*c) if c else ((),) * batch.num_rows for c in cols)
            out = []
            for now, mine, row in zip(batch.column(batch.schema.get_field_index(micros)).to_pylist(), own, given):
                if mine != key:
                    key, state = mine, machine.start()
                out.append(machine.step(state, now, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "refused"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return events.repartition(*keys).sortWithinPartitions(*keys, micros, *order).mapInArrow(run, f"{kinds}, refused string")


def trailing_counts(events: DataFrame, keys: list[str], micros: str, window_s: float, buckets: int = 64) -> DataFrame:
    """Adds ``n``: the key's rows within the window that ends with each row, both ends and ties included.

    A key's time is cut into buckets, ``buckets`` a window, so that a key of very many rows is many groups: a
    count is that of the rows up to now less that before the window, each the sum of the buckets
    before and a place within one bucket.
    """
    width = int(window_s * 1_000_000)
    step = max(1, width // buckets)
    moments = events.groupBy(*keys, F.col(micros).alias("_t")).agg(F.count("*").alias("_m"))
    mark = lambda t, m, kind: moments.select(*keys, "_t", t.alias("_at"), m.alias("_add"), F.lit(kind).alias("_kind"), F.floor(t / step).alias("_bucket"))
    # kind 0 asks for the rows before its time, kind 1 adds its own and asks with them
    marks = mark(F.col("_t") - width, F.lit(0), 0).unionByName(mark(F.col("_t"), F.col("_m"), 1))
    names = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, names)]
    by = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.groupBy(*named, F.col("_bucket").alias("_b")).agg(F.sum("_add").alias("_sum_b")).withColumn("_before", F.coalesce(F.sum("_sum_b").over(by), F.lit(0))).drop("_sum_b")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.col("_bucket") == F.col("_b"))
    up_to = F.when(F.col("_kind") == 1, 1).otherwise(-1) * (F.col("_before") + F.col("_sum"))
    totals = marks.withColumn("_sum", F.sum("_add").over(inside)).join(before, same).select(*names, "_t", up_to.alias("_n"))
    counts = totals.groupBy(*names, "_t").agg(F.sum("_n").alias("n"))
    joined = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.col(micros) == F.col("_t"))
    return events.join(counts, joined).drop("_t", *names)
