"""The alert poll: what has come since the last one, appended to the outbox table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts

EVERY = "30 minutes"


def poll(reports: DataFrame, alerts_of: Callable[[DataFrame], DataFrame], outbox: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query over a stream of reports: every half hour (or once over what there is) the
    alerts of the new reports are written, a batch to its own folder, so that a batch that is run
    again replaces its rows."""

    def send(batch: DataFrame, number: int) -> None:
        alerts_of(batch).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    writer = reports.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def sent_since(ticks: DataFrame, outbox: str, as_of, hours: int, but: int) -> DataFrame:
    """Rows of the outbox's folders of the last ``hours``, without those of one batch."""
    spark = ticks.sparkSession
    schema = "user_id bigint, title string, body string, data string, sent_at timestamp_ntz, day date, batch bigint"
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    path = spark._jvm.org.apache.hadoop.fs.Path(outbox)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", outbox).parquet(outbox)
    return rows.where((F.col("day") >= since.cast("date")) & (F.col("sent_at") > since) & (F.col("batch") != but))


def poll_active(ticks: DataFrame, alerts_at: Callable[[Column], DataFrame], outbox: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query over a stream of polls (``poll_at``): at the newest poll of a batch all alerts that
    hold then are told, but for texts that the outbox has for the user within the cooldown.

    The outbox is the memory: its folders are by day, so a poll reads a day or two, and by batch, so
    that a batch that is run again finds what others sent and writes its own rows anew.
    """

    def send(batch: DataFrame, number: int) -> None:
        as_of = batch.agg(F.max(F.col("poll_at").cast("timestamp_ntz"))).first()[0]
        if as_of is None:
            return
        now = F.lit(as_of).cast("timestamp_ntz")
        found = alerts.due(alerts_at(now), sent_since(batch, outbox, as_of, alerts.COOLDOWN_HOURS, number), now)
        alerts.outbox(found, now).write.mode("overwrite").parquet(f"{outbox}/day={as_of.date()}/batch={number}")

    writer = ticks.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()
