"""Finite streams over the tables, each against SQL over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.queries.registry import Tables, twin
from barloom.session import shared_dir
from barloom.streaming import committed, state


def stream(t: Tables, name: str) -> DataFrame:
    """The table as a stream of its files."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parquet*")


def finished(df: DataFrame, name: str) -> DataFrame:
    """Run a finite stream to its end into files, and read them."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    state.started(writer, spark).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


@twin("""
SELECT sha256(text) AS content_hash, length(text)::BIGINT AS n_chars FROM documents WHERE trim(text) <> '' GROUP BY text""")
def stream_dedup(t: Tables) -> DataFrame:
    """Every content once, by keyed state instead of what was written before."""
    rows = stream(t, "documents").select(F.col("doc_id").alias("position"), F.col("text").alias("raw_content"))
    return finished(state.new_chunks_stream(rows).select("content_hash", F.length("raw_content").cast("long").alias("n_chars")), "dedup")


@twin("""
WITH e AS (SELECT user_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN value / 20 END AS effort, CASE WHEN event_id % 2 = 0 THEN value / 100 END AS make FROM events),
b AS (SELECT date_trunc('day', max(ts)) AS upto FROM e),
p AS (SELECT DISTINCT user_id, event_type, moment FROM (SELECT user_id, event_type, ts AS moment FROM e UNION ALL SELECT user_id, event_type, ts + INTERVAL 14 DAY FROM e), b WHERE moment <= upto),
s AS (SELECT p.user_id, p.event_type, p.moment, count(effort) AS ne, avg(effort) AS effort, count(make) AS nm, avg(make) AS make FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.event_type = p.event_type AND e.ts <= p.moment AND e.ts > p.moment - INTERVAL 14 DAY GROUP BY ALL),
k AS (SELECT user_id, event_type, moment, 'effort_above_target' AS kind, coalesce(ne >= 2 AND effort > 1.5, false) AS holds, effort AS value FROM s UNION ALL SELECT user_id, event_type, moment, 'low_make_rate', coalesce(nm >= 2 AND make < 0.7, false), make FROM s),
l AS (SELECT *, coalesce(lag(holds) OVER (PARTITION BY user_id, event_type, kind ORDER BY moment), false) AS held FROM k)
SELECT user_id, event_type, kind, moment AS started_at, round(value, 6) AS value FROM l WHERE holds AND NOT held""")
def warning_starts(t: Tables) -> DataFrame:
    """When the last fourteen days of a user's events of a type begin to be a warning, up to the last midnight."""
    events = stream(t, "events")
    rows = events.select("user_id", "event_type", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value") / 20).alias("effort"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 100).alias("make"))
    keys = {c: events.schema[c].dataType.simpleString() for c in ("user_id", "event_type")}
    found = finished(state.warning_starts(rows, keys, mean=state.mean_of_doubles), "warnings")
    upto = t.events.agg(F.date_trunc("day", F.max("ts"))).scalar()
    found = found.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    return found.where(F.col("started_at") <= upto).withColumn("value", F.round("value", 6))


@twin("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM orders) AS audited FROM orders GROUP BY 1""")
def committed_rows(t: Tables) -> DataFrame:
    """Orders written in units of 50 rows, each with an audit row, and read back."""
    path = f"{shared_dir(t.spark)}/committed-{uuid.uuid4().hex}"
    committed.write(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    rows = committed.rows(t.spark, path, "o_orderstatus string, o_totalprice double")
    audited = committed.audit(t.spark, path).agg(F.sum("n_rows")).scalar()
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("audited", audited)
