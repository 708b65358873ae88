"""An import as one unit: a table of runs, results in a folder of the run's own, and a pointer to the
current one that moves in one step."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .staged import files_of

RUN = "run_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, rows_received long, rows_valid long, rows_quarantined long, rows_inserted long, rows_updated long, rows_unchanged long, rows_marked_stale long, error_summary string"
COUNTS = ["received", "valid", "quarantined", "inserted", "updated", "unchanged"]


def _note(spark: SparkSession, root: str, **values) -> None:
    spark.createDataFrame([Row(**{f.split()[0]: values.get(f.split()[0]) for f in RUN.split(", ")})], RUN).coalesce(1).write.mode("append").parquet(f"{root}/runs")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Each run as it stands: a finished row takes the place of the one that says it began."""
    rows = spark.read.schema(RUN).parquet(f"{root}/runs")
    last = F.max_by(F.struct(*rows.columns), F.struct(F.col("status") != "running", F.coalesce("completed_at", "started_at")))
    return rows.groupBy("run_id").agg(last.alias("r")).select("r.*")


def current(spark: SparkSession, root: str) -> str | None:
    """The run whose results are current: the pointer with the highest number."""
    files, at = files_of(spark, f"{root}/current")
    if not files.exists(at):
        return None
    names = sorted(x.getPath().getName() for x in files.listStatus(at) if not x.getPath().getName().startswith((".", "_")))
    return names[-1].split("-", 1)[1] if names else None


def table(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """A result of the current run, or of a given one."""
    run = run or current(spark, root)
    if run is None:
        raise LookupError(f"no run of {root} is complete")
    return spark.read.parquet(f"{root}/results/{run}/{name}")


def _publish(spark: SparkSession, root: str, run: str) -> None:
    """Makes a run current: one file is created under the next number, which no other run can have."""
    files, at = files_of(spark, f"{root}/current")
    files.mkdirs(at)
    taken = [int(x.getPath().getName().split("-")[0]) for x in files.listStatus(at) if x.getPath().getName()[:1].isdigit()]
    _, place = files_of(spark, f"{root}/current/{max(taken, default=0) + 1:012d}-{run}")
    files.create(place, False).close()


def run_import(spark: SparkSession, root: str, work: Callable[[], tuple[dict[str, DataFrame], DataFrame]], as_of, run: str | None = None) -> str:
    """Runs ``work``, which gives tables by name and a row of statistics (``etl.statistics``).  The tables are
    written to the run's folder; only when all are there the run becomes current and is completed.  If
    anything raises, what was current stays so, and the run's row says failed and why."""
    run = run or uuid.uuid4().hex
    _note(spark, root, run_id=run, status="running", started_at=as_of)
    try:
        tables, statistics = work()
        for name, df in tables.items():
            df.write.mode("error").parquet(f"{root}/results/{run}/{name}")
        counts = statistics.first().asDict()
        _publish(spark, root, run)
    except Exception as error:
        _note(spark, root, run_id=run, status="failed", started_at=as_of, completed_at=as_of, error_summary=str(error)[:1000])
        files, at = files_of(spark, f"{root}/results/{run}")
        files.delete(at, True)
        raise
    _note(spark, root, run_id=run, status="completed", started_at=as_of, completed_at=as_of, rows_marked_stale=counts.get("stale"), **{f"rows_{c}": counts[c] for c in COUNTS})
    return run
