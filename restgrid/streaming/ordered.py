"""Rules over the rows of a key in order of event time, as streams.

Rows wait in a buffer of their key until the watermark has passed them, so that every row which is
not too late takes its place, and what comes out is what the batch functions give for the same
rows, however they arrive.  The state of a key goes when it can't say anything more.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Ordered(StatefulProcessor):
    def __init__(self, machine, schema: T.StructType, order: list[str]):
        self.machine, self.schema = machine, schema
        self.row = Row(*schema.fieldNames(), "refused")
        self.inputs = [schema.fieldNames().index(c) for c in machine.inputs]
        self.by = [schema.fieldNames().index(c) for c in ("_t", *order)]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for r in rows]
        if new:
            self.waiting.appendList(new)
            for ms in {-(-r[self.by[0]] // 1000) for r in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[self.by[0]] <= passed), key=lambda r: [r[i] for i in self.by])
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        out = [self.row(*r, self.machine.step(state, r[self.by[0]], [r[i] for i in self.inputs])) for r in due]
        if due:
            left = [r for r in rows if r[self.by[0]] > passed]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        until = self.machine.reach(state)
        if until < passed and len(due) == len(rows):
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            if until >= passed:
                self.handle.registerTimer(until // 1000 + 1)
        yield from out

    def close(self) -> None:
        pass


def judged(events: DataFrame, keys: list[str], order: list[str], ts: str, machine, late: str = "10 minutes") -> DataFrame:
    """The stream's rows with ``refused``, as ``sequence.judged`` gives it: each row once the watermark has
    passed it, in order of ``ts``, then ``order``.  Rows that come later than ``late`` are dropped."""
    use_store(events)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_t", F.unix_micros(ts)).withWatermark(ts, late)
    made = T.StructType([*timed.schema.fields, T.StructField("refused", T.StringType())])
    return timed.groupBy(*keys).transformWithState(_Ordered(machine, timed.schema, order), made, "Append", "EventTime").drop("_t")


class _Expiry(StatefulProcessor):
    def __init__(self, schema: T.StructType):
        self.schema, self.row, self.at = schema, Row(*schema.fieldNames()), schema.fieldNames().index("_t")
        self.off = schema.fieldNames().index("is_expired")

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.schema)

    def _ends(self, row) -> int:
        return row[self.at] // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        for row in map(tuple, rows):
            if self.held.exists():
                self.handle.deleteTimer(self._ends(tuple(self.held.get())))
                self.held.clear()
            if row[self.off] or row[self.at] is None:
                continue
            if self._ends(row) <= timerValues.getCurrentWatermarkInMs():
                yield self.row(*row)
            else:
                self.held.update(row)
                self.handle.registerTimer(self._ends(row))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            yield self.row(*self.held.get())
            self.held.clear()

    def close(self) -> None:
        pass


def expired(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A row for each report of the stream, with is_expired, once the watermark (of created_at) is past its
    expires_at.  A later row of the same report_id takes the place of the earlier; one that is expired
    by hand, or has no end, emits nothing."""
    use_store(reports)
    timed = reports.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("_t", F.unix_micros(F.col("expires_at").cast("timestamp"))).withWatermark("created_at", late)
    return timed.groupBy("report_id").transformWithState(_Expiry(timed.schema), timed.schema, "Append", "EventTime").drop("_t").withColumn("is_expired", F.lit(True))
