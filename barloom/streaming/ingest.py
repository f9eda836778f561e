"""Streaming counterparts: idempotent chunk ingest by content hash, and event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from barloom.compat import strip
from barloom.operators.relational import keep_first
from barloom.session import exists, ship

EMBED_CHARS, EMBED_BATCH, EMBED_ATTEMPTS = 30_000, 100, 3


def new_chunks(batch: DataFrame, loaded: DataFrame | None, order: str = "position") -> DataFrame:
    """Rows of a batch to load: not empty, first of their hash, hash not loaded yet.  Dedup comes before embedding."""
    rows = batch.withColumn("content_hash", F.sha2("raw_content", 256)).where(strip(F.col("raw_content")) != "")
    rows = keep_first(rows, ["content_hash"], F.col(order))
    return rows if loaded is None else rows.join(loaded.select("content_hash"), "content_hash", "left_anti")


def hash_embedding(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding service: dims numbers from hashes of the text."""
    return lambda text: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(20001)) / 10000.0 - 1.0).cast("float"))


def embedded(rows: DataFrame, embed: Callable[[Column], Column], text: str = "content") -> DataFrame:
    return rows.withColumn("embedding", embed(F.substring(F.col(text), 1, EMBED_CHARS)))


def embedded_in_batches(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str, text: str = "content", attempts: int = EMBED_ATTEMPTS) -> DataFrame:
    """key, embedding by a service that takes up to EMBED_BATCH texts a call; a call is tried ``attempts`` times, then fails the task."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), EMBED_BATCH):
                part = batch.slice(i, EMBED_BATCH)
                texts = [(t or "")[:EMBED_CHARS] for t in part.column(1).to_pylist()]
                for attempt in range(attempts):
                    try:
                        found = embed(texts)
                        break
                    except Exception:  # an external service: any failure is worth another try
                        if attempt == attempts - 1:
                            raise
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(work, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def load_batch(spark: SparkSession, target: str, ledger: str | None = None, embed: Callable[[Column], Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: append new chunks to ``target``, then the batch's ids to ``ledger``.

    The target is laid out by the first byte of the hash, so a batch reads hashes alone, and of those folders that its
    own rows can be in.  The ledger is made from what the target holds of the batch: a batch that is run again after a
    crash between the two writes adds to the ledger what is missing there, and nothing to the target.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        slots = [r[0] for r in new_chunks(batch, None).select(F.substring("content_hash", 1, 2)).distinct().collect()]  # 256 at most
        loaded = spark.read.schema("content_hash string, slot string").parquet(target).where(F.col("slot").isin(slots)) if exists(spark, target) else None
        rows = new_chunks(batch, loaded)
        rows = embedded(rows, embed) if embed else rows
        rows = rows.withColumns({"batch_id": F.lit(batch_id).cast("long"), "slot": F.substring("content_hash", 1, 2)})
        rows.write.mode("append").partitionBy("slot").parquet(target)
        if ledger:
            own = spark.read.schema(rows.schema).parquet(target).where(F.col("slot").isin(slots) & (F.col("batch_id") == batch_id)).select("content_hash", "batch_id")
            if exists(spark, ledger):
                own = own.join(spark.read.schema("content_hash string, batch_id long").parquet(ledger), ["content_hash", "batch_id"], "left_anti")
            own.write.mode("append").parquet(ledger)

    return load


def ingest_stream(chunks: DataFrame, target: str, checkpoint: str, ledger: str | None = None, embed: Callable[[Column], Column] | None = None) -> DataStreamWriter:
    """Stream of chunks into ``target``; what has been read is in the checkpoint, so a restart goes on from there."""
    return chunks.writeStream.foreachBatch(load_batch(chunks.sparkSession, target, ledger, embed)).option("checkpointLocation", checkpoint)


def dedup_within(chunks: DataFrame, ts: str, delay: str, column: str = "content_hash") -> DataFrame:
    """Stream without repeats, with state only for the time of the watermark."""
    return chunks.withWatermark(ts, delay).dropDuplicatesWithinWatermark([column])


def resumed(rows: DataFrame, position: str, done: int) -> DataFrame:
    """The rows after those that a failed run had finished."""
    return rows.where(F.col(position) >= done)


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Extension: count and sum of value by key and window; batch or stream."""
    rows = events if watermark is None else events.withWatermark(ts, watermark)
    out = rows.groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Extension: as tumbling, for overlapping windows."""
    rows = events if watermark is None else events.withWatermark(ts, watermark)
    out = rows.groupBy(*keys, F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Extension: runs of events no further apart than the gap."""
    rows = events if watermark is None else events.withWatermark(ts, watermark)
    out = rows.groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), "n", "total")
