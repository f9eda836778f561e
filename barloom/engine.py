"""Whole workloads: ingest files, plan programmes for all athletes, export; each composes the operators and writes tables.

    python -m barloom.engine ingest FILES OUT [AUTHOR [TYPE]] [--dry-run]
    python -m barloom.engine retag OUT VOCABULARY.json [SOURCE_ID] [--dry-run]
    python -m barloom.engine log-session LOGS.parquet CHANGES.json OUT
    python -m barloom.engine log-exercise ENTRIES.json PLANNED.parquet OUT
    python -m barloom.engine export-log LOG.parquet OUT
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import dates as D
from barloom.functions.collections import same_set
from barloom.operators import exports, jobs
from barloom.operators import sections as S
from barloom.operators.keywords import Tagger
from barloom.operators.merge import upsert, write_csv
from barloom.operators.records import logged_entries
from barloom.operators.source_upsert import upserted
from barloom.operators.store import Store, Transaction
from barloom.plans import rules
from barloom.session import staged
from barloom.sources import files
from barloom.streaming.ingest import new_chunks


def chunk_table(documents: DataFrame, keywords: Mapping[str, Sequence[str]] | DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, title, author, text) with metadata and validation, whatever their route."""
    rows = S.classified(S.sections(documents.withColumnRenamed("title", "source_title")), "content")
    rows = rows.select("*", F.col("c.type").alias("type"), F.col("c.confidence").alias("confidence")).drop("c")
    rows = rows.where(F.array_contains(S.routes(F.col("type")), "chunks"))
    pair = S.web_size(F.size(F.split("content", r"\s+")))
    rows = rows.withColumns({"section_no": F.col("ordinal"), "chunk_type": S.chunk_type(F.col("title"), F.col("content"), F.col("type")), "size": pair["size"], "overlap": pair["overlap"]})
    out = S.assembled(S.chunks(rows), keywords)
    return out.withColumn("check", S.validated(F.col("token_count"), F.col("topics"), F.col("raw_content")))


# Kinds of documents, and the types of their sources.
SOURCE_TYPES = {"book": "book", "article": "article", "program": "manual", "structured": "manual", "website": "website"}


def ingest(spark: SparkSession, path: str, target: str, keywords: Mapping[str, Sequence[str]] | DataFrame | None = None, run_id: str | None = None, author: str = "", doc_type: str = "book", dry_run: bool = False) -> DataFrame:
    """Read files, cut and tag them, add what ``target`` (a store) does not hold yet, and log the run: sources, chunks and runs, or none.

    A file's name and ``author`` make its source.  dry_run: the totals of the run that would be, and nothing written.
    """
    run = run_id or uuid.uuid4().hex
    store = Store(spark, target)
    pages = files.extract(spark, path)
    docs = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    docs = docs.select(F.monotonically_increasing_id().alias("position"), F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.lit(author).alias("author"), "text")
    docs = staged(docs, "ingest-texts")

    def work(tx: Transaction) -> DataFrame | None:
        empty = spark.createDataFrame([], "id long, title string, author string, source_type string, url string")
        titles = docs.select("position", "title", "author", F.lit(SOURCE_TYPES.get(doc_type, "book")).alias("source_type"), F.lit(None).cast("string").alias("url"))
        sources, ids = upserted(tx.read("sources") if "sources" in tx.tables else empty, titles)
        of = docs.select("doc_id", "position").join(ids, "position").select(F.col("doc_id").alias("__d"), "source_id")
        place = F.struct("doc_id", "section_no", "ordinal").alias("position")
        found = chunk_table(docs.drop("position"), keywords or {}).withColumn("run_id", F.lit(run)).select("*", place).join(of, F.col("doc_id") == F.col("__d")).drop("__d")
        loaded = tx.read("chunks").select("content_hash") if "chunks" in tx.tables else None
        new = staged(new_chunks(found, loaded).drop("position", "size", "overlap"), "ingest-chunks")
        out = jobs.totals(new, ["run_id"], {"chunks": F.lit(True), "valid": F.col("check.is_valid"), "flagged": ~F.col("check.is_valid")}, {"tokens": F.col("token_count")})
        if dry_run:
            return out
        tx.overwrite("sources", sources)
        tx.append("runs", out.withColumn("ts", F.current_timestamp()))
        if "chunks" not in tx.tables or not new.isEmpty():
            tx.append("chunks", new)
        return None

    out = store.change(work)
    return out if dry_run else store.read("runs").where(F.col("run_id") == run).drop("ts")


def retag(spark: SparkSession, target: str, keywords: Mapping[str, Sequence[str]] | DataFrame, source_id: int | None = None, dry_run: bool = False) -> DataFrame:
    """Topics of stored chunks by a new vocabulary: one row with scanned, updated and newly_tagged (before without any topic).

    source_id: only that source's chunks.  Chunks are written anew only if some change; dry_run: never.
    """
    tagger = Tagger(spark, keywords)

    def work(tx: Transaction) -> DataFrame:
        rows = tx.read("chunks")
        chosen = F.lit(True) if source_id is None else F.col("source_id") == source_id
        rows = staged(rows.withColumn("__new", F.when(chosen, S.topics_of(F.col("raw_content"), F.col("chunk_type"), tagger))), "retag-chunks")
        other = F.col("__new").isNotNull() & ~same_set(F.col("topics"), F.col("__new"))
        counts = staged(rows.agg(F.count_if(F.col("__new").isNotNull()).alias("scanned"), F.count_if(other).alias("updated"), F.count_if(other & (F.size("topics") == 0)).alias("newly_tagged")), "retag-counts")
        if not dry_run and counts.first().updated:
            tx.overwrite("chunks", rows.withColumn("topics", F.when(other, F.col("__new")).otherwise(F.col("topics"))).drop("__new"))
        return counts

    return Store(spark, target).change(work)


def plan(athletes: DataFrame, today: Column) -> DataFrame:
    """Weekly targets of the next programme of every athlete, with the hardest exercises it may have.

    athletes: athlete_id, level, goal, event_date, sessions_per_week, previous_phase, adherence_pct, make_rate,
    rpe_deviation (the outcome of the previous programme, null without one).
    """
    previous, outcome = F.col("previous_phase"), [F.col(c) for c in ("adherence_pct", "make_rate", "rpe_deviation")]
    decided = rules.next_phase(previous, *outcome)
    chosen = rules.phase_and_weeks(D.weeks_out(F.col("event_date"), today), previous, decided["phase"], F.col("goal"))
    volume, ceiling = rules.load_deltas(*outcome)
    rows = athletes.select("athlete_id", "level", "sessions_per_week", "previous_phase", chosen["phase"].alias("phase"), F.when(previous.isNull(), F.least(chosen["weeks"], F.lit(rules.FIRST_WEEKS))).otherwise(chosen["weeks"]).alias("duration"), rules.max_complexity(previous, F.col("level")).alias("max_complexity"), F.coalesce(volume, F.lit(0.0)).alias("d_volume"), F.coalesce(ceiling, F.lit(0.0)).alias("d_ceiling"))
    targets = rules.weekly_targets(rows)
    # one pass for both kinds of programmes: first ones have no changes but a cap
    first, bounds = F.col("previous_phase").isNull(), ("intensity_floor", "intensity_ceiling")
    change = lambda c: F.when(first, F.lit(0.0)).otherwise(F.col(c))
    adjusted = rules.adjusted_targets(targets, change("d_volume"), change("d_ceiling"))
    capped = rules.cold_start(adjusted.withColumns({f"__{c}": F.col(c) for c in bounds}))
    out = capped.withColumns({c: F.when(first, F.col(c)).otherwise(F.col(f"__{c}")) for c in bounds}).drop(*[f"__{c}" for c in bounds])
    return rules.week_totals(out.drop("d_volume", "d_ceiling"), "sessions_per_week")


def log_sessions(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """Session logs after new ones: one a session, and any number without a session."""
    return upsert(logs, changes, ["session_id"])


def log_exercises(entries: DataFrame, planned: DataFrame) -> DataFrame:
    """Entries with their deviations from the plan, ready to be appended."""
    return logged_entries(entries, planned)


def export_log(rows: DataFrame, path: str) -> None:
    """One athlete's training log as CSV."""
    write_csv(exports.training_log(rows), path)


def export_programs(programs: DataFrame, rows: DataFrame, path: str) -> None:
    """Every programme's CSV text as a table of files: program_id, file_name, content."""
    exports.program_files(programs, rows).write.mode("overwrite").parquet(path)


def main(args: Sequence[str]) -> None:
    from barloom.session import session

    spark = session()
    dry_run, args = "--dry-run" in args, [a for a in args if a != "--dry-run"]
    match args:
        case ["ingest", source, target, *more] if len(more) <= 2:
            ingest(spark, source, target, **dict(zip(("author", "doc_type"), more)), dry_run=dry_run).show()
        case ["retag", target, words, *more] if len(more) <= 1:
            retag(spark, target, S.vocabulary(spark, words), *map(int, more), dry_run=dry_run).show()
        case ["log-session", logs, changes, target]:
            old = spark.read.parquet(logs)
            log_sessions(old, spark.read.schema(old.schema).json(changes)).write.parquet(target)
        case ["log-exercise", entries, planned, target]:
            log_exercises(spark.read.json(entries), spark.read.parquet(planned)).write.parquet(target)
        case ["export-log", source, target]:
            export_log(spark.read.parquet(source), target)
        case _:
            raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
