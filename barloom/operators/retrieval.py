"""Retrieval: exact filtered cosine top-k, and structured lookups on arrays and JSON."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barloom.compat import all_of, any_of, array_length, asc, desc
from barloom.functions.collections import contains_all, open_or_contains, open_or_equal, overlaps
from barloom.operators.relational import first_seen_union, top_per
from barloom.session import shared_dir, ship

LEVELS = {"low": 1, "medium": 2, "high": 3}
DEFAULT_K, MIN_SIMILARITY = 5, 0.45
#: Characters of a run in the index of names.
GRAM = 3
#: Queries compared in one pass over the vectors.
QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def metadata_filter(chunk_types: Sequence[str] | None = None, topics: Sequence[str] | None = None, level: str | None = None, min_density: str | None = None, require_numbers: bool = False) -> Column:
    """Conjunction of the filters that are given; true if none is."""
    parts: list[Column] = []
    if chunk_types:
        parts.append(F.col("chunk_type").isin(list(chunk_types)))
    if topics:
        parts.append(overlaps(F.col("topics"), F.array(*map(F.lit, topics))))
    if level:
        parts.append(F.col("athlete_level").isNull() | F.col("athlete_level").isin("all", level))
    if min_density:
        rank = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
        parts.append(F.coalesce(rank[F.col("information_density")], F.lit(0)) >= LEVELS.get(min_density, 0))
    if require_numbers:
        parts.append(F.col("contains_specific_numbers"))
    return all_of(*parts)


def cosine_topk(vectors: DataFrame, query: Sequence[float] | Column, k: int = DEFAULT_K, where: Column | None = None, floor: float | None = None, vec: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """The k most similar rows.  Filters come before the similarity and the floor before k; ids break ties."""
    rows = vectors if where is None else vectors.where(where)
    q = query if isinstance(query, Column) else literal_vector(query)
    rows = rows.withColumn("similarity", cosine(F.col(vec), q))
    rows = rows if floor is None else rows.where(F.col("similarity") >= floor)
    return rows.orderBy(F.col("similarity").desc_nulls_last(), id_column).limit(k)


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, floor: float | None = None) -> DataFrame:
    """As cosine_topk for a table of queries (query, qvec), each with its own top k over all vectors.

    Queries go through in blocks of about QUERY_BLOCK, one pass over the vectors each; with several blocks, each is written to
    the shared folder and what was sent to the tasks is gone before the next, so it is bounded.  A task compares its vectors with the block batch by batch and keeps k a query: no pairs are listed, and
    only those rows are shuffled.  Similarities within 1e-12 count as equal, and ids break ties.
    """
    spark = vectors.sparkSession
    ship(spark)
    kinds = {"query": queries.schema["query"].dataType, "vec_id": vectors.schema["vec_id"].dataType}
    schema = pa.schema([*[(c, to_arrow_type(t)) for c, t in kinds.items()], ("similarity", pa.float64())])
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    path = f"{shared_dir(spark)}/barloom-topk-{uuid.uuid4().hex}" if blocks > 1 else None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", F.col("qvec").cast("array<double>").alias("q")).where("q IS NOT NULL").toArrow()
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value.column("query").combine_chunks(), np.array(shared.value.column("q").to_pylist(), float)
            query, vec, sim = np.zeros(0, np.int64), np.asarray(pa.array([], schema.field("vec_id").type)), np.zeros(0)
            for batch in batches:
                if not len(batch) or not len(q):
                    continue
                v = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)
                size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(size > 0, np.round(q @ v.T / size, 12), -np.inf)
                least = np.partition(s, -min(k, len(batch)), axis=1)[:, -min(k, len(batch))]
                at, col = np.nonzero((s >= least[:, None]) & np.isfinite(s) & (s >= (-1.5 if floor is None else floor)))
                query, vec, sim = (np.concatenate(x) for x in ((query, at), (vec, np.asarray(batch.column(0))[col]), (sim, s[at, col])))
                order = np.lexsort((vec, -sim, query))
                query, vec, sim = query[order], vec[order], sim[order]
                kept = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, vec, sim = query[kept], vec[kept], sim[kept]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(vec, schema.field("vec_id").type), pa.array(sim)], schema=schema)

        found = rows.mapInArrow(work, f"query {kinds['query'].simpleString()}, vec_id {kinds['vec_id'].simpleString()}, similarity double")
        found = top_per(found, ["query"], k, F.col("similarity").desc(), F.col("vec_id"))
        if path is None:
            return found
        found.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(found.schema).parquet(path)


def fault_exercises(exercises: DataFrame, faults: Sequence[str], families: Sequence[str], max_complexity: int, n: int = 10) -> DataFrame:
    """The simplest exercises of each family that address a fault, those that address most first; all families in one pass."""
    rows = exercises.where(F.col("movement_family").isin(list(families)) & (F.col("complexity") <= max_complexity) & overlaps(F.col("faults_addressed"), F.array(*map(F.lit, faults))))
    return top_per(rows, ["movement_family"], n, asc("complexity"), desc(array_length(F.col("faults_addressed"))), F.col("name"))


def matching_templates(templates: DataFrame, phase: str, level: str, sessions: int, n: int = 3) -> DataFrame:
    rows = templates.where(contains_all(F.col("phases_included"), F.array(F.lit(phase))) & F.col("sessions_per_week").between(sessions - 1, sessions + 1) & F.col("athlete_level").isin(level, "any"))
    return rows.orderBy(asc("source_id"), "id").limit(n)


def active_principles(principles: DataFrame, phase: str, level: str, n: int = 20) -> DataFrame:
    """Principles whose optional conditions (a variant column) admit phase and level, by priority."""
    c = F.col("condition")
    rows = principles.where(open_or_equal(c, "$.phase", F.lit(phase)) & open_or_contains(c, "$.athlete_level", F.lit(level)))
    return rows.orderBy(desc("priority"), "id").limit(n)


def search_names(df: DataFrame, column: str, keywords: Sequence[str], n: int) -> DataFrame:
    """Rows whose text has any of the keywords."""
    low = F.lower(F.col(column))
    return df.where(any_of(*[F.contains(low, F.lit(k.lower())) for k in keywords])).orderBy("id").limit(n)


def substitutes(pairs: DataFrame, exercises: DataFrame) -> DataFrame:
    """Original and substitute names of each pair, and the array of substitutes by original."""
    a, b = exercises.alias("a"), exercises.alias("b")
    rows = pairs.join(a, pairs.exercise_id == F.col("a.id")).join(b, pairs.substitute_id == F.col("b.id"))
    named = rows.select(F.col("a.name").alias("exercise"), F.col("b.name").alias("substitute"))
    return named.groupBy("exercise").agg(F.array_sort(F.collect_set("substitute")).alias("substitutes"))


def merged_results(results: Sequence[DataFrame], id_column: str = "chunk_id") -> DataFrame:
    """Results of several searches; a chunk counts for the first search that found it."""
    return first_seen_union(results, id_column, F.col("similarity").desc())


def grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of ``size`` characters of a text."""
    n = F.length(text)
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, texts: DataFrame, size: int = GRAM) -> DataFrame:
    """needle, text: all pairs of a needle and a text that contains it, by an inverted index of character runs.

    needles (needle) and texts (text) are distinct and not null.  A needle is looked up by one run alone, the one of its runs that
    the fewest texts have; what shares it is compared whole.  Needles shorter than ``size`` are looked up by runs of
    their own length; an empty needle, which is in every text, finds none.
    """
    short = F.least(F.length("needle"), F.lit(size))
    own = needles.where("needle <> ''").select("needle", F.explode(grams(F.col("needle"), short)).alias("gram"))
    wanted = own.select("gram").distinct()
    # only runs that some needle has are kept of the texts, of each length up to size
    runs = F.explode(F.flatten(F.array(*[grams(F.col("text"), i) for i in range(1, size + 1)])))
    index = texts.select("text", runs.alias("gram")).join(wanted, "gram", "left_semi")
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = own.join(held, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


def suggestions(rows: DataFrame, names: DataFrame, column: str = "exercise_name", n: int = 3) -> DataFrame:
    """Unknown names with up to n known ones that contain them or are contained; blank names suggest nothing.

    Both directions go through an index of character runs (see contained()), so no names are compared that share none.
    Only the n smallest suggestions of a name are gathered.
    """
    known = names.select(F.lower("name").alias("low"), F.col("name").alias("suggestion")).where("low IS NOT NULL").distinct()
    unknown = rows.select(column).distinct().join(known.select(F.col("low").alias("__k")), F.lower(F.col(column)) == F.col("__k"), "left_anti")
    asked = unknown.withColumn("__low", F.lower(F.trim(F.col(column))))
    low, lows = asked.where("__low <> ''").select(F.col("__low").alias("low")).distinct(), known.select("low").distinct()
    inside = contained(low.withColumnRenamed("low", "needle"), lows.withColumnRenamed("low", "text")).select(F.col("needle").alias("asked"), F.col("text").alias("found"))
    around = contained(lows.withColumnRenamed("low", "needle"), low.withColumnRenamed("low", "text")).select(F.col("text").alias("asked"), F.col("needle").alias("found"))
    pairs = inside.unionByName(around).distinct().join(known, F.col("found") == F.col("low")).select("asked", "suggestion").distinct()
    near = top_per(pairs, ["asked"], n, F.col("suggestion")).groupBy("asked").agg(F.array_sort(F.collect_list("suggestion")).alias("suggestions"))
    out = asked.join(near, F.col("__low") == F.col("asked"), "left")
    return out.select(column, F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
