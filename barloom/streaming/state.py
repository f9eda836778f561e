"""Streams with keyed state: deduplication without end, and warnings of the last fourteen days.

State is kept by key in the state store (RocksDB, on disk and in the checkpoint), so a batch touches the keys that it
has and reads nothing of what was written before.  A query that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from math import fsum

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from barloom.compat import strip
from barloom.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000
#: Digits of a mean: past them doubles differ by the order in which they are added, so a mean of 0.7 might be below 0.7.
MEAN_DIGITS = 12


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """The query of a writer, with keyed state."""
    with keyed_state(spark):
        return writer.start()


class FirstSeen(StatefulProcessor):
    """The first row of each key, by ``order`` among those of one batch; later rows of the key are dropped."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: (r[self.order] is not None, r[self.order]))

    def close(self) -> None:
        pass


def new_chunks_stream(chunks: DataFrame, order: str = "position", text: str = "raw_content") -> DataFrame:
    """Stream of chunks as new_chunks() gives them of a table: not empty, each content once, over all batches and restarts."""
    ship(chunks.sparkSession)
    rows = chunks.withColumn("content_hash", F.sha2(text, 256)).where(strip(F.col(text)) != "")
    return rows.groupBy("content_hash").transformWithState(FirstSeen(order), outputStructType=rows.schema, outputMode="append", timeMode="none")


def mean(values: Sequence[float]) -> float | None:
    """The same in any order of the values."""
    return round(fsum(values) / len(values), MEAN_DIGITS) if values else None


def mean_of_doubles(values: Sequence[float]) -> float | None:
    """As SQL averages a column of doubles: added up one by one in their order, with what each addition loses."""
    total = 0.0
    for v in values:  # sum() makes up for what additions lose
        total += v
    return total / len(values) if values else None


def in_time(event: tuple) -> tuple:
    """Order of events; of the same time the smaller values first, wherever rows lie."""
    return event[0], *[(v is not None, v or 0.0) for v in event[1:]]


class WarningStarts(StatefulProcessor):
    """When a condition on the events of the last days begins to hold.

    State of a key: events that the watermark has not reached yet, those of the last days, and which conditions hold.
    Events take effect in order of time, whatever order they come in, once the watermark is past them; one timer a key
    waits for the next event to take effect or to leave.  A key without events has no state.  ``mean`` takes values in
    order of time.
    """

    def __init__(self, keys: list[str], days: int, least: int, effort_above: float, make_below: float, mean: Callable[[Sequence[float]], float | None] = mean):
        self.keys, self.mean = keys, mean
        self.span, self.least, self.effort_above, self.make_below = days * DAY, least, effort_above, make_below

    def init(self, handle) -> None:
        self.handle = handle
        events = "at long, effort double, make double"
        self.pending, self.recent = handle.getListState("pending", events), handle.getListState("recent", events)
        self.holding = handle.getValueState("holding", "effort boolean, make boolean")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.pending.appendList([(r["at"], r["effort"], r["make"]) for r in rows])
        return self._moved(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        return self._moved(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _conditions(self, recent: list[tuple]) -> dict[str, tuple[bool, float | None]]:
        efforts, makes = [e for _, e, _ in recent if e is not None], [m for _, _, m in recent if m is not None]
        effort, make = self.mean(efforts), self.mean(makes)
        return {
            "effort_above_target": (len(efforts) >= self.least and effort > self.effort_above, effort),
            "low_make_rate": (len(makes) >= self.least and make < self.make_below, make),
        }

    def _moved(self, key, to: int) -> Iterator[Row]:
        """Go through all points of time up to the watermark at which an event comes or leaves."""
        pending, recent = sorted(map(tuple, self.pending.get()), key=in_time), [tuple(e) for e in self.recent.get()]
        holds = dict(zip(("effort_above_target", "low_make_rate"), self.holding.get() if self.holding.exists() else (False, False)))
        out, came = [], 0
        while True:
            points = [e[0] for e in pending[came : came + 1]] + [e[0] + self.span for e in recent[:1]]
            if not points or min(points) > to:
                break
            now = min(points)
            while came < len(pending) and pending[came][0] <= now:
                recent.append(pending[came])
                came += 1
            recent = [e for e in recent if e[0] > now - self.span]
            for kind, (on, value) in self._conditions(recent).items():
                if on and not holds[kind]:
                    out.append(Row(**dict(zip(self.keys, key)), kind=kind, at=now, value=value))
                holds[kind] = on
        pending = pending[came:]
        timer = self.timer.get()[0] if self.timer.exists() else None
        due = min(points) // 1000 + 1 if points else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            for state in (self.pending, self.recent, self.holding, self.timer):
                state.clear()
            return iter(out)
        self.pending.put(pending) if pending else self.pending.clear()
        self.recent.put(recent) if recent else self.recent.clear()
        self.holding.update(tuple(holds.values()))
        self.timer.update((due,))
        return iter(out)

    def close(self) -> None:
        pass


def warning_starts(events: DataFrame, keys: dict[str, str], days: int = 14, least: int = 2, effort_above: float = 1.5, make_below: float = 0.7, delay: str = "0 seconds", mean: Callable[[Sequence[float]], float | None] = mean) -> DataFrame:
    """Stream of (keys, kind, started_at, value): a row when the mean of the last ``days`` days begins to be a warning.

    events: the key columns, ts, effort, make.  keys: name -> type.  A warning that goes on is not repeated; one that ended
    because its events left may begin again.  Events later than ``delay`` behind the latest are dropped.  mean: that of decimals,
    or mean_of_doubles.
    """
    ship(events.sparkSession)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL").withWatermark("ts", delay).select(*keys, "ts", F.unix_micros("ts").alias("at"), F.col("effort").cast("double").alias("effort"), F.col("make").cast("double").alias("make"))
    schema = ", ".join(f"`{k}` {t}" for k, t in keys.items()) + ", kind string, at long, value double"
    out = rows.groupBy(*keys).transformWithState(WarningStarts(list(keys), days, least, effort_above, make_below, mean), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return out.select(*keys, "kind", F.timestamp_micros("at").alias("started_at"), "value")


def warning_starts_batch(events: DataFrame, keys: dict[str, str], upto: Column, days: int = 14, least: int = 2, effort_above: float = 1.5, make_below: float = 0.7) -> DataFrame:
    """As warning_starts(), of a table, up to a point of time: running sums over events that come and leave."""
    from pyspark.sql import Window

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL").select(*keys, F.unix_micros("ts").alias("at"), F.col("effort").cast("double").alias("effort"), F.col("make").cast("double").alias("make"))
    points = rows.select(*keys, F.explode(F.array("at", F.col("at") + days * DAY)).alias("point")).where(F.col("point") <= F.unix_micros(upto)).distinct()
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    inside = points.alias("p").join(rows.alias("e"), [*same, F.col("e.at") <= F.col("point"), F.col("e.at") > F.col("point") - days * DAY], "left")
    stats = inside.groupBy(*[F.col(f"p.{k}").alias(k) for k in keys], "point").agg(F.count("effort").alias("ne"), F.round(F.avg("effort"), MEAN_DIGITS).alias("effort"), F.count("make").alias("nm"), F.round(F.avg("make"), MEAN_DIGITS).alias("make"))
    on = {"effort_above_target": ((F.col("ne") >= least) & (F.col("effort") > effort_above), "effort"), "low_make_rate": ((F.col("nm") >= least) & (F.col("make") < make_below), "make")}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(False)).alias("on"), F.col(v).alias("value")) for k, (c, v) in on.items()]))
    tall = stats.select(*keys, "point", kinds.alias("x")).select(*keys, "point", "x.*")
    before = F.lag("on", 1, False).over(Window.partitionBy(*keys, "kind").orderBy("point"))
    return tall.withColumn("was", before).where("on AND NOT was").select(*keys, "kind", F.timestamp_micros("point").alias("started_at"), "value")
