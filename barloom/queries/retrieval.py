"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import collections as C
from barloom.operators import analytics as A
from barloom.operators import relational as R
from barloom.operators import retrieval as V
from barloom.queries.registry import Tables, twin


def query_vector(t: Tables, vec_id: int = 0) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("qvec"))


SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.v)"


@twin(f"SELECT vec_id, round({SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q ORDER BY {SIM} DESC, vec_id LIMIT 5")
def cosine_topk(t: Tables) -> DataFrame:
    both = t.embeddings.join(query_vector(t))
    return V.cosine_topk(both, F.col("qvec")).select("vec_id", F.round("similarity", 6).alias("similarity"))


@twin(f"SELECT vec_id, label, round({SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q WHERE label IN (1, 2, 3) AND {SIM} >= 0.05 ORDER BY {SIM} DESC, vec_id LIMIT 5")
def cosine_topk_filtered(t: Tables) -> DataFrame:
    """Filters and floor before k."""
    both = t.embeddings.join(query_vector(t))
    return V.cosine_topk(both, F.col("qvec"), where=F.col("label").isin(1, 2, 3), floor=0.05).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@twin(f"""
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, vec_id, label, {SIM} AS sim FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rn FROM s)
SELECT query, count(*) AS results, count(DISTINCT label) AS sources, round_even(min(sim), 3) AS low, round_even(max(sim), 3) AS high, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
  bool_or(label IN (query % 7, query % 3 + 5)) AS topic_hit, bool_or(label = query % 10) AS type_hit FROM r WHERE rn <= 5 GROUP BY query""")
def retrieval_eval(t: Tables) -> DataFrame:
    """Quality figures of the top 5 of a fixed set of queries."""
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    hits = V.cosine_topk_batch(t.embeddings, queries).join(t.embeddings.select("vec_id", "label"), "vec_id")
    label = F.col("label").cast("string")
    hits = hits.select("query", F.col("label").alias("source"), "similarity", F.array(label).alias("topics"), label.alias("chunk_type"))
    q = F.col("query")
    cases = queries.select("query", F.array((q % 7).cast("string"), (q % 3 + 5).cast("string")).alias("expected_topics"), F.array((q % 10).cast("string")).alias("expected_types"))
    return A.retrieval_quality(hits, cases).select("query", "results", "sources", "low", "high", F.array_join("topics", ",").alias("labels"), "topic_hit", "type_hit")


@twin(f"""
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, {SIM} AS sim FROM embeddings e, q)
SELECT query, vec_id, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, vec_id) <= 10""")
def topk_pruned(t: Tables) -> DataFrame:
    """The 10 nearest of a fixed set of queries among all vectors, by an index that skips what cannot be near."""
    from barloom.operators.vector_index import PivotIndex

    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    found = PivotIndex.build(t.embeddings).topk(queries, 10)
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


@twin("""
SELECT o_orderkey, list_has_any(k, [1, 2]) AS any_of, list_has_all(k, [1, 2]) AS all_of FROM (SELECT o_orderkey, list(DISTINCT l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def array_overlap(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_set("l_linenumber").alias("k"))
    want = F.array(F.lit(1), F.lit(2))
    return rows.select("o_orderkey", C.overlaps(F.col("k"), want).alias("any_of"), C.contains_all(F.col("k"), want).alias("all_of"))


@twin("""
SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.k') = '7' AS equal, json_extract_string(props, '$.k')::DOUBLE <= 50 AS small,
  props IS NULL OR json_extract_string(props, '$.missing') IS NULL AS open FROM events""")
def json_predicate(t: Tables) -> DataFrame:
    v = F.try_parse_json("props")
    rows = t.events.withColumn("v", v)
    c = F.col("v")
    return rows.select("event_id", F.try_variant_get(c, "$.k", "int").alias("k"), (C.json_text(c, "$.k") == "7").alias("equal"), (F.try_variant_get(c, "$.k", "double") <= 50).alias("small"), C.open_or_equal(c, "$.missing", F.lit("x")).alias("open"))


@twin("""
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"phase": "a", "level": ["x", "y"]}' WHEN 2 THEN '{"phase": ["a"], "level": "x"}' WHEN 3 THEN '{"level": null}' ELSE '{"load": {"lte": 5, "gt": 1}}' END AS c, event_id % 7 AS p FROM events)
SELECT event_id FROM r WHERE (c IS NULL OR json_extract_string(c, '$.phase') IS NULL OR json_extract_string(c, '$.phase') = 'a')
  AND (c IS NULL OR json_extract(c, '$.level') IS NULL OR json_extract_string(c, '$.level') = 'x' OR coalesce(list_contains(CASE WHEN json_type(c, '$.level') = 'ARRAY' THEN json_extract_string(c, '$.level[*]') END, 'x'), false))
ORDER BY p DESC, event_id LIMIT 20""")
def rule_predicates(t: Tables) -> DataFrame:
    """Optional conditions of principles: text equality, and membership in a list or scalar; JSON null does not match."""
    k = F.col("event_id") % 5
    text = F.when(k == 1, '{"phase": "a", "level": ["x", "y"]}').when(k == 2, '{"phase": ["a"], "level": "x"}').when(k == 3, '{"level": null}').when(k == 4, '{"load": {"lte": 5, "gt": 1}}')
    rows = t.events.select(F.col("event_id").alias("id"), F.try_parse_json(text).alias("condition0"), (F.col("event_id") % 7).alias("priority"))
    c = F.col("condition0")
    good = rows.where(C.open_or_equal(c, "$.phase", F.lit("a")) & C.open_or_contains(c, "$.level", F.lit("x")))
    return good.orderBy(F.desc("priority"), "id").limit(20).select(F.col("id").alias("event_id"))


@twin("""
WITH h AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents WHERE trim(text) <> '') SELECT doc_id, sha256(text) AS content_hash FROM h WHERE rn = 1""")
def hash_dedup_keep_first(t: Tables) -> DataFrame:
    from barloom.streaming.ingest import new_chunks

    rows = new_chunks(t.documents.select("doc_id", F.col("text").alias("raw_content")), None, "doc_id")
    return rows.select("doc_id", "content_hash")


@twin("""
WITH a AS (SELECT p_partkey AS id, p_name AS name, (SELECT max(p_partkey) + 1 FROM part) AS n FROM part) SELECT x.name AS exercise, string_agg(DISTINCT y.name, ',' ORDER BY y.name) AS substitutes FROM a x JOIN a y ON y.id = (x.id * 7 + 3) % x.n GROUP BY 1""")
def substitutes(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    n = t.part.agg(F.max("p_partkey") + 1).scalar()
    pairs = parts.select(F.col("id").alias("exercise_id"), ((F.col("id") * 7 + 3) % n).alias("substitute_id"))
    return V.substitutes(pairs, parts).select("exercise", F.array_join("substitutes", ",").alias("substitutes"))


@twin("""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rn, embedding[1]::DOUBLE AS s FROM embeddings), b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS rn, embedding[2]::DOUBLE AS s FROM embeddings),
u AS (SELECT vec_id AS chunk_id, s, 0 AS n FROM a WHERE rn <= 20 UNION ALL SELECT vec_id, s, 1 FROM b WHERE rn <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n, s DESC) AS k FROM u)
SELECT chunk_id, n::INT AS source_no, round(s, 6) AS similarity FROM r WHERE k = 1""")
def merged_results(t: Tables) -> DataFrame:
    top = lambda i: t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding")[i].cast("double").alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(20)
    return V.merged_results([top(0), top(1)]).select("chunk_id", "source_no", F.round("similarity", 6).alias("similarity"))


@twin("""
SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY event_type""")
def latest_per_key(t: Tables) -> DataFrame:
    return R.latest_by(t.events, ["event_type"], "ts", "event_id").join(t.events.groupBy("event_type").agg(F.max("ts").alias("ts")), "event_type")


@twin("""
WITH i AS (SELECT 'k' || (page_id % 40) AS urlkey, url AS original, strftime(TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (page_id % 7), '%Y%m%d%H%M%S') AS timestamp, page_id AS position FROM pages),
f AS (SELECT * FROM i WHERE NOT regexp_matches(original, '#top') AND regexp_matches(original, '/(en|fr|de)/'))
SELECT urlkey, arg_max(original, (timestamp, -position)) AS original, max(timestamp) AS timestamp FROM f GROUP BY urlkey""")
def archive_index(t: Tables) -> DataFrame:
    from barloom.sources.web import latest_captures

    stamp = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 7).cast("int")), "yyyyMMddHHmmss")
    index = t.pages.select(F.concat(F.lit("k"), (F.col("page_id") % 40).cast("string")).alias("urlkey"), F.col("url").alias("original"), stamp.alias("timestamp"), F.col("page_id").alias("position"))
    return latest_captures(index, "#top", "/(en|fr|de)/")


@twin("""
SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def pending_urls(t: Tables) -> DataFrame:
    from barloom.sources.web import pending

    rows = t.pages.select(F.col("page_id").alias("position"), "url")
    return pending(rows, rows.where("position % 3 = 0")).select(F.col("position").alias("page_id"), "url")
