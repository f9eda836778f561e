"""Runs and jobs: totals, admission of requests, progress in flushes, resuming."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import ship

#: Seconds that a request blocks its athlete at most, seconds of a job, and those kept back from it.
IN_FLIGHT_SECONDS, JOB_SECONDS, RESERVE_SECONDS = 660, 600, 30
FLUSH_EVERY, CHECKPOINT_EVERY = 10, 10


def totals(rows: DataFrame, keys: Sequence[str], counts: Mapping[str, Column], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Totals of a run: rows that meet each condition, and sums (0 for none)."""
    out = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]
    out += [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (sums or {}).items()]
    return rows.groupBy(*keys).agg(*out)


def counts_by(rows: DataFrame, *keys: Column | str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def admitted(requests: DataFrame, seconds: int = IN_FLIGHT_SECONDS) -> DataFrame:
    """Requests (athlete_id, request_id, at, finished_at) with ``admitted``: one an athlete is in flight at a time.

    A request that is let in blocks its athlete until it finishes, or for ``seconds`` at most.  An athlete's requests
    stream through in order of time and request_id; all that is held of them is until when the athlete is blocked.
    """
    ship(requests.sparkSession)
    limit = F.col("at") + F.make_interval(secs=F.lit(float(seconds)))
    rows = requests.select("athlete_id", "request_id", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("__at"), F.unix_micros(F.least(F.coalesce("finished_at", limit), limit).cast("timestamp")).alias("__until"))
    rows = rows.repartition("athlete_id").sortWithinPartitions("athlete_id", F.asc_nulls_first("__at"), "request_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = None
        for batch in batches:
            said = []
            for at, to in zip(batch.column("__at").to_pylist(), batch.column("__until").to_pylist()):
                free = until is None or at is not None and at >= until
                until = to if free else until
                said.append(free)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("athlete_id", "request_id", "at")), pa.array(said, pa.bool_())], names=["athlete_id", "request_id", "at", "admitted"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("athlete_id", "request_id", "at"))
    return rows.groupBy("athlete_id").applyInArrow(work, f"{schema}, admitted boolean")


def deadline(started: Column, seconds: int = JOB_SECONDS, reserve: int = RESERVE_SECONDS) -> Column:
    """When a job that started then has to be done."""
    return started + F.make_interval(secs=F.lit(float(seconds - reserve)))


def flushes(done: DataFrame, keys: Sequence[str], order: Sequence[str], url: str = "url", every: int = FLUSH_EVERY) -> DataFrame:
    """Each finished URL of a source once, with the number of the flush (from 0) that writes it."""
    first = Window.partitionBy(*keys, url).orderBy(*order)
    rows = done.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, url)) - 1
    return rows.withColumn("flush_no", F.floor(place / every).cast("int"))


def progress_json(done: DataFrame, keys: Sequence[str], url: str = "url") -> DataFrame:
    """keys, progress: the sorted JSON list of a source's finished URLs."""
    return done.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_set(url))).alias("progress"))


def resume_points(runs: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """file_hash, resume_from: where the latest failed run of a file stopped; nothing for files that a run completed.

    runs: run_id, file_hash, status, processed, ts.  Progress is kept every ``every`` sections.
    """
    last = runs.groupBy("file_hash").agg(F.max_by(F.struct("status", "processed"), F.struct("ts", "run_id")).alias("r"), F.max((F.col("status") == "completed").cast("int")).alias("__done"))
    return last.where("__done = 0 AND r.status = 'failed'").select("file_hash", (F.floor(F.col("r.processed") / every) * every).cast("int").alias("resume_from"))


def remaining_sections(sections: DataFrame, points: DataFrame) -> DataFrame:
    """Sections (file_hash, position) that are still to do."""
    at = points.select(F.col("file_hash").alias("__h"), F.col("resume_from").alias("__from"))
    return sections.join(at, F.col("file_hash") == F.col("__h"), "left").where(F.col("position") >= F.coalesce("__from", F.lit(0))).drop("__h", "__from")
