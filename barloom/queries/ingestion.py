"""Document ingestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.operators import sections as S
from barloom.operators.keywords import Tagger
from barloom.queries.functions import MAIN_TEXT_SQL, STRIPPED_SQL
from barloom.queries.registry import Tables, twin
from barloom.sources import files
from barloom.sources import web as W
from barloom.streaming import ingest as I

#: A small keyword table; a full vocabulary is a parameter of the operators.
KEYWORDS = {"the": ["english"], "ing": ["english"], "der": ["german"], "ung": ["german"], "que": ["french"], "ción": ["spanish"]}


@twin(r"""
SELECT doc_id, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::INT AS tokens,
  len(regexp_extract_all(text, '[0-9]+%')) * 2 + len(regexp_extract_all(text, '[0-9]+\s*[xX×]\s*[0-9]+')) * 3 + len(regexp_extract_all(text, '(?i)(?:snatch|clean|jerk|squat|pull|press|deadlift)')) AS score FROM documents""")
def token_density(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", T.token_estimate(c).alias("tokens"), T.density_score(c, F.lit(False)).alias("score"))


@twin("""
WITH t AS (SELECT doc_id, list_distinct(list_filter(['english', 'german', 'french', 'spanish'], lambda k: (k = 'english' AND (contains(lower(text), 'the') OR contains(lower(text), 'ing'))) OR (k = 'german' AND (contains(lower(text), 'der') OR contains(lower(text), 'ung')))
  OR (k = 'french' AND contains(lower(text), 'que')) OR (k = 'spanish' AND contains(lower(text), 'ción')))) AS k, doc_id % 3 = 0 AS r FROM documents)
SELECT doc_id, array_to_string(list_sort(CASE WHEN r THEN list_concat(k, ['recovery_protocols', 'adaptation_theory']) ELSE k END), ',') AS topics FROM t""")
def topic_union(t: Tables) -> DataFrame:
    """Topics of the text and those its type always has."""
    kind = F.when(F.col("doc_id") % 3 == 0, "recovery_adaptation").otherwise("concept")
    return t.documents.select("doc_id", F.array_join(S.topics_of(F.col("text"), kind, Tagger(t.spark, KEYWORDS)), ",").alias("topics"))


#: Keywords of benchmark texts: words of six letters or more, each with two topics.
VOCABULARY_SQL = r"""w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\s+')) AS keyword FROM benchmark),
v AS (SELECT keyword, 'starts_' || left(keyword, 1) AS topic FROM w WHERE length(keyword) >= 6 UNION ALL SELECT keyword, 'letters_' || length(keyword) FROM w WHERE length(keyword) >= 6)"""


def vocabulary(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("keyword")).distinct().where(F.length("keyword") >= 6)
    topics = F.array(F.concat(F.lit("starts_"), F.left("keyword", F.lit(1))), F.concat(F.lit("letters_"), F.length("keyword").cast("string")))
    return words.select("keyword", F.explode(topics).alias("topic"))


@twin(f"""
WITH {VOCABULARY_SQL} SELECT doc_id, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM documents JOIN v ON contains(lower(text), keyword) GROUP BY doc_id""")
def keyword_tag(t: Tables) -> DataFrame:
    """Topics of hundreds of keywords, anywhere in the text, also inside words: one automaton over all texts."""
    return Tagger(t.spark, vocabulary(t)).tagged(t.documents, "doc_id", "text").select("doc_id", F.array_join("topics", ",").alias("topics"))


@twin(f"""
WITH {VOCABULARY_SQL}, d AS (SELECT doc_id, source, lower(text) AS text FROM documents),
n AS (SELECT doc_id, list_sort(list_distinct(list(topic))) AS topics FROM d JOIN v ON contains(text, keyword) GROUP BY doc_id),
o AS (SELECT doc_id, list_sort(list_distinct(list(topic))) AS topics FROM d JOIN v ON contains(text, keyword) WHERE length(keyword) < 9 GROUP BY doc_id)
SELECT source, count(*) AS scanned, count(*) FILTER (WHERE coalesce(n.topics, []) <> coalesce(o.topics, [])) AS updated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id) GROUP BY source""")
def retag_changes(t: Tables) -> DataFrame:
    """Rows whose topic set changes when longer keywords come into the vocabulary, by source."""
    from barloom.functions.collections import same_set

    words = vocabulary(t)
    old, new = Tagger(t.spark, words.where(F.length("keyword") < 9)), Tagger(t.spark, words)
    rows = t.documents.select("source", old.topics(F.col("text")).alias("old"), new.topics(F.col("text")).alias("new"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~same_set(F.col("old"), F.col("new"))).alias("updated"))


def classify_sql(table: str, keys: str, text: str) -> str:
    """CTE c with what classify() looks at (programme and exercise patterns do not occur in the tables), and expressions of type and confidence."""
    rules = [r"should\s+(?:not\s+)?exceed", r"never\s+(?:go|exceed|perform|do)", r"always\s+(?:include|perform|start|use)", r"(?:reduce|increase|maintain)\s+.*(?:by|to|at)\s+[0-9]+", r"(?:no more than|at least|a minimum of)\s+[0-9]+", r"(?:rule of thumb|general guideline|as a rule)"]
    score = " + ".join(f"regexp_matches({text}, '(?i){r}')::INT" for r in rules)
    return f"""c AS (SELECT {keys}, {text} AS content, len(regexp_extract_all({text}, '(?m)^.*\\|.*\\|.*$')) >= 3 AS tab, regexp_matches({text}, '[0-9]+%') AS pct, len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) AS n, {score} AS score FROM {table})"""


TYPE_SQL = "CASE WHEN tab THEN 'table' WHEN score >= 2 AND n > 100 AND pct THEN 'mixed' WHEN score >= 3 THEN 'principle' ELSE 'prose' END"
CONFIDENCE_SQL = "CASE WHEN tab THEN 0.85 WHEN score >= 2 AND n > 100 AND pct THEN 0.75 WHEN score >= 3 THEN 0.7 WHEN n >= 50 AND (score >= 1 OR pct) THEN 0.55 WHEN n < 50 THEN 0.6 ELSE 0.8 END::DOUBLE"


@twin(f"""
WITH {classify_sql("documents", "doc_id", "text")} SELECT doc_id, {TYPE_SQL} AS type, {CONFIDENCE_SQL} AS confidence FROM c""")
def classify(t: Tables) -> DataFrame:
    out = S.classified(t.documents.select("doc_id", "text"), "text")
    return out.select("doc_id", "c.type", F.col("c.confidence").cast("double").alias("confidence"))


@twin(f"""
WITH {classify_sql("documents", "source", "text")} SELECT source, {TYPE_SQL} AS type, count(*) AS n FROM c GROUP BY ALL""")
def type_counts(t: Tables) -> DataFrame:
    """Sections by type, as a run logs them."""
    from barloom.operators.jobs import counts_by

    return counts_by(S.classified(t.documents.select("source", "text"), "text"), "source", F.col("c.type").alias("type"))


def sections_sql(texts: str) -> str:
    """Sections of texts (doc_id, text) whose headers are lines of their own."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"""
WITH d AS ({texts}), x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT *, regexp_matches(line, '^(#{{1,3}}\\s+.+|Chapter\\s+\\d+.*|PART\\s+[IVX]+.*|\\d+\\.\\d+\\s+[A-Z].+)$') AS h FROM x),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
b AS (SELECT doc_id, sec, max(CASE WHEN h THEN {strip("line")} END) AS title, {strip("coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY i), '')")} AS body FROM s GROUP BY doc_id, sec),
k AS (SELECT *, last_value(CASE WHEN contains(lower(title), 'chapter') THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM b),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no, coalesce(chapter, '') AS chapter, coalesce(title, '') AS title, body FROM k WHERE body <> ''
  UNION ALL SELECT doc_id, 0, '', '', text FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id AND body <> '')),
{classify_sql("r", "doc_id, section_no, chapter, title", "body")}
SELECT doc_id, section_no::INT AS section_no, chapter, title, {TYPE_SQL} AS type, {CONFIDENCE_SQL} AS confidence, CASE {TYPE_SQL} WHEN 'mixed' THEN 'chunks,principles' WHEN 'principle' THEN 'principles' ELSE 'chunks' END AS routes, sha256(content) AS content_hash FROM c"""


def section_rows(df: DataFrame) -> DataFrame:
    rows = S.classified(S.sections(df).withColumnRenamed("ordinal", "section_no"), "content")
    return rows.select("*", F.col("c.type").alias("type"), F.col("c.confidence").alias("confidence")).drop("c")


def routed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "section_no", "chapter", "title", "type", F.round("confidence", 2).cast("double").alias("confidence"), F.array_join(S.routes(F.col("type")), ",").alias("routes"), F.sha2("content", 256).alias("content_hash"))


@twin(sections_sql("SELECT doc_id, coalesce(text, '') AS text FROM documents"))
def sections(t: Tables) -> DataFrame:
    """Sections of all documents, classified and routed."""
    return routed(section_rows(t.documents.select("doc_id", "text")))


HEADING_SQL = "CASE turn % 4 WHEN 0 THEN 'Chapter ' || turn || ' of ' || role WHEN 1 THEN '## ' || role WHEN 2 THEN '1.' || turn || ' About' ELSE 'plain line' END"


@twin(sections_sql(f"SELECT conv_id AS doc_id, string_agg({HEADING_SQL} || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"))
def headed_sections(t: Tables) -> DataFrame:
    """Conversations as documents with chapters and headings, cut into sections."""
    k = F.col("turn")
    head = F.when(k % 4 == 0, F.concat(F.lit("Chapter "), k.cast("string"), F.lit(" of "), "role")).when(k % 4 == 1, F.concat(F.lit("## "), "role")).when(k % 4 == 2, F.concat(F.lit("1."), k.cast("string"), F.lit(" About"))).otherwise("plain line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, F.lit("\n"), "text").alias("p")))), lambda x: x["p"]), "\n")
    return routed(section_rows(t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(text.alias("text"))))


def chunk_rows(t: Tables) -> DataFrame:
    rows = section_rows(t.documents.select("doc_id", "source", "text")).withColumns({"size": F.lit(900), "overlap": F.lit(200), "source_title": F.col("source"), "author": F.lit(""), "chunk_type": S.chunk_type(F.col("title"), F.col("content"), F.col("type"))})
    return S.assembled(S.chunks(rows), KEYWORDS)


def chunk_sql() -> str:
    """CTE k: chunks of the documents, whose texts have neither headers nor empty lines, so that each is one chunk of one section."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kind = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lead, {quoted(w)})' for w in words)} THEN '{name}'" for name, words in S.TYPE_WORDS.items()) + " WHEN type = 'mixed' THEN 'programming_rationale' ELSE 'concept' END"
    numbers = " OR ".join(f"regexp_matches(raw, {quoted(p)})" for p in (T.REP_SCHEME, T.PERCENT_OF_MAX, T.PERCENT_SERIES))
    score = f"len(regexp_extract_all(raw, {quoted(T.PERCENT)})) * 2 + len(regexp_extract_all(raw, {quoted(T.SETS_BY_REPS)})) * 3 + len(regexp_extract_all(raw, {quoted(T.LIFT_WORDS)})) + CASE WHEN {numbers} THEN 5 ELSE 0 END"
    found = ", ".join(f"CASE WHEN contains(lower(raw), '{k}') THEN '{x}' END" for k, topics in KEYWORDS.items() for x in topics)
    fixed = "CASE kind " + " ".join(f"WHEN '{name}' THEN [{', '.join(map(quoted, topics))}]" for name, topics in S.TYPE_TOPICS.items()) + " ELSE [] END"
    return f"""{classify_sql("documents", "doc_id, source", "text")},
h AS (SELECT doc_id, source, {TYPE_SQL} AS type, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS raw, lower(left(content, 800)) AS lead FROM c),
i AS (SELECT *, {kind} AS kind, floor((len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: w <> '')) + CASE WHEN source <> '' THEN 2 ELSE 0 END) * 1.3::DOUBLE)::INT AS tokens, {score} AS score FROM h WHERE raw <> ''),
k AS (SELECT *, list_sort(list_distinct(list_filter(list_concat([{found}], {fixed}), lambda x: x IS NOT NULL))) AS topics, CASE WHEN score >= 10 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS density FROM i)"""


@twin(f"""
WITH {chunk_sql()} SELECT doc_id, 0 AS section_no, 0 AS chunk_no, '' AS section_title, 0 AS chunk_index, kind AS chunk_type, tokens AS token_count, density AS information_density, array_to_string(topics, ',') AS topics, sha256(raw) AS content_hash FROM k""")
def chunks(t: Tables) -> DataFrame:
    """Chunks of all documents with their metadata."""
    return chunk_rows(t).select("doc_id", "section_no", F.col("ordinal").alias("chunk_no"), "section_title", "chunk_index", "chunk_type", "token_count", "information_density", F.array_join("topics", ",").alias("topics"), "content_hash")


@twin(f"""
WITH {chunk_sql()},
v AS (SELECT *, tokens < 50 AS a, tokens > 1500 AS b, len(topics) = 0 AS c, len(regexp_extract_all(raw, '{T.REP_SCHEME}')) >= 3 AS d,
  len(list_filter(string_split(raw, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR length(x) - length(replace(x, chr(9), '')) >= 2)) >= 3 AS e, regexp_matches(raw, '^\\p{{Ll}}') AS f FROM k)
SELECT doc_id, 0 AS section_no, 0 AS chunk_no, sha256(raw) AS content_hash, concat_ws(',', CASE WHEN a THEN 'too_short' END, CASE WHEN b THEN 'too_long' END, CASE WHEN c THEN 'no_topics' END, CASE WHEN d THEN 'rep_schemes' END, CASE WHEN e THEN 'table_like' END, CASE WHEN f THEN 'starts_lowercase' END) AS issues,
  CASE WHEN e OR f THEN 'warning' WHEN d THEN 'info' WHEN a OR b OR c THEN 'warning' ELSE 'info' END AS severity, NOT (a OR b OR c OR d OR e OR f) AS is_valid FROM v""")
def chunk_validate(t: Tables) -> DataFrame:
    """Findings and severity of every chunk."""
    rows = chunk_rows(t).withColumn("v", S.validated(F.col("token_count"), F.col("topics"), F.col("raw_content")))
    return rows.select("doc_id", "section_no", F.col("ordinal").alias("chunk_no"), "content_hash", F.array_join("v.issues", ",").alias("issues"), "v.severity", "v.is_valid")


@twin(r"""
WITH v AS (SELECT doc_id, text, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS tokens, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR length(x) - length(replace(x, chr(9), '')) >= 2)) >= 3 AS tab FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN tokens < 50 THEN 'too_short' END, CASE WHEN tokens > 1500 THEN 'too_long' END, CASE WHEN tab THEN 'table_like' END, CASE WHEN regexp_matches(trim(text), '^\p{Ll}') THEN 'starts_lowercase' END) AS issues FROM v""")
def validate_documents(t: Tables) -> DataFrame:
    """The chunk checks on whole documents."""
    v = S.validated(T.token_estimate(F.col("text")), F.array(F.lit("x")), F.col("text"))
    return t.documents.select("doc_id", F.array_join(v["issues"], ",").alias("issues"))


@twin(f"""
WITH {MAIN_TEXT_SQL} SELECT page_id, {STRIPPED_SQL.format(x="head")} AS title, length(body)::INT AS n_chars, sha256(body) AS text_hash FROM art JOIN body USING (page_id)""")
def html_text(t: Tables) -> DataFrame:
    """Main text of every page."""
    rows = files.html_text(t.pages)
    return rows.select("page_id", W.head_title(F.col("html")).alias("title"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@twin(r"""
WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href=["'']([^"'']*/[a-z]+[^"'']*)["'']', 1), lambda u: CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://x.example' || u END) AS u FROM pages)
SELECT page_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS links, len(list_distinct(u)) AS n_links FROM l""")
def article_links(t: Tables) -> DataFrame:
    out = W.article_links(t.pages, "page_id", "html", "https://x.example", "/[a-z]+")
    return out.select("page_id", F.array_join("urls", " ").alias("links"), F.size("urls").cast("long").alias("n_links"))


@twin("""
SELECT page_id, CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (403, 408, 429) OR s >= 500 THEN 'transient' ELSE 'permanent' END AS class FROM (SELECT page_id, list_extract([200, 204, 301, 403, 404, 408, 429, 500, 503], (page_id % 9 + 1)::INT) AS s FROM pages)""")
def retry_classes(t: Tables) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (200, 204, 301, 403, 404, 408, 429, 500, 503)])
    return t.pages.select("page_id", W.retry_class(F.element_at(codes, (F.col("page_id") % 9 + 1).cast("int"))).alias("class"))


@twin(r"""
SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS slug, md5(url) AS url_md5, trim(regexp_extract(lower(url), '^https?://([^/:?#]*)', 1)) AS host FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.slug(F.col("url")).alias("slug"), F.md5("url").alias("url_md5"), W.same_host(F.col("url")).alias("host"))


@twin("""
SELECT p_partkey, replace(replace(lower(p_name), ' ', '_'), '&', 'and') AS ref, CASE WHEN contains(lower(p_name), 'red') THEN 'pull' WHEN contains(lower(p_name), 'ring') THEN 'press' ELSE 'accessory' END AS family, trim(substr(split_part(p_name, 'g', 1), 1, 400)) AS lead FROM part""")
def name_functions(t: Tables) -> DataFrame:
    n = F.col("p_name")
    family = S.first_hit(F.lower(n), {"pull": ["red"], "press": ["ring"]}, "accessory")
    return t.part.select("p_partkey", T.lift_ref(n).alias("ref"), family.alias("family"), F.trim(F.substring(F.split_part(n, F.lit("g"), F.lit(1)), 1, 400)).alias("lead"))


@twin("""
SELECT doc_id, CASE WHEN s = '' AND a = '' THEN '' ELSE '[' || concat_ws(' | ', CASE WHEN s <> '' THEN 'Source: ' || s END, CASE WHEN a <> '' THEN 'Author: ' || a END) || ']' || chr(10) || chr(10) END AS preamble
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS s, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS a FROM documents)""")
def preambles(t: Tables) -> DataFrame:
    s, a = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")
    return t.documents.select("doc_id", T.preamble(s, a, F.lit(""), F.lit("")).alias("preamble"))


@twin(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\bThe\b', 'Teh', 'g'), '\bof\b', 'fo', 'g')) AS fixed FROM documents""")
def ordered_corrections(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.corrected(F.col("text"), {"The": "Teh", "of": "fo"}), 256).alias("fixed"))


@twin("SELECT user_id, event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(t: Tables) -> DataFrame:
    return I.tumbling(t.events, "ts", "1 hour", "user_id", "event_type").withColumn("total", F.round("total", 4))


@twin("""
SELECT user_id, time_bucket(INTERVAL '1 hour', ts) - INTERVAL 1 HOUR * k AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1), (2)) v(k) GROUP BY ALL""")
def event_sliding(t: Tables) -> DataFrame:
    return I.sliding(t.events, "ts", "3 hours", "1 hour", "user_id").withColumn("total", F.round("total", 4))


@twin("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, sid""")
def event_session(t: Tables) -> DataFrame:
    return I.sessions(t.events, "ts", "6 hours", "user_id").withColumn("total", F.round("total", 4))


#: Pages as rows of sources: many of a title, some titles with brackets of their own, some rows without URL, each URL again under another title.
SOURCE_ROWS_SQL = r"""p AS (SELECT page_id, regexp_extract(url, '^https?://(?:m\.|blog\.)?([^./]*)', 1) AS host, url FROM pages),
rows AS (SELECT page_id AS position, CASE WHEN page_id % 11 = 0 THEN host || ' [' || page_id % 3 || ']' ELSE host END AS title, CASE WHEN page_id % 4 <> 3 THEN regexp_replace(url, '[0-9]+.*$', (page_id % 3)::VARCHAR || '/') || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' END END AS url FROM p
  UNION ALL SELECT page_id + 1000000, 'other', regexp_replace(url, '[0-9]+.*$', (page_id % 3)::VARCHAR || '/') FROM p),
sources AS (SELECT min(page_id) + 1 AS id, host AS title, CASE WHEN min(page_id) % 2 = 1 THEN min(url) END AS url FROM p WHERE page_id % 9 = 0 GROUP BY host)"""


@twin(f"""
WITH RECURSIVE {SOURCE_ROWS_SQL},
r AS (SELECT row_number() OVER (ORDER BY position) AS n, * FROM rows),
f AS (
  SELECT 0::BIGINT AS n, (SELECT list({{'id': id, 'title': title, 'url': url}}) FROM sources) AS s, NULL::BIGINT AS position, NULL::BIGINT AS source_id
  UNION ALL
  SELECT n, CASE WHEN hit IS NULL THEN list_append(s, {{'id': new_id, 'title': own, 'url': url}}) WHEN by_url IS NULL AND url IS NOT NULL AND hit.url IS NULL THEN list_transform(s, lambda x: CASE WHEN x.id = hit.id THEN {{'id': x.id, 'title': x.title, 'url': url}} ELSE x END) ELSE s END,
    position, CASE WHEN hit IS NULL THEN new_id ELSE hit.id END
  FROM (
    SELECT *, CASE WHEN by_url IS NOT NULL THEN by_url WHEN NOT clash THEN by_title ELSE list_filter(s, lambda x: x.title = own)[1] END AS hit FROM (
      SELECT *, CASE WHEN NOT clash THEN title WHEN len(list_filter(s, lambda x: x.title = candidate)) > 0 THEN title || ' [' || left(md5(url), 8) || ']' ELSE candidate END AS own FROM (
        SELECT *, by_title IS NOT NULL AND url IS NOT NULL AND by_title.url IS NOT NULL AND by_title.url <> url AS clash, title || ' [' || string_split(regexp_replace(url, '/+$', ''), '/')[-1] || ']' AS candidate FROM (
          SELECT r.n, f.s, r.position, r.title, r.url, (SELECT max(id) FROM sources) + 1 + r.position AS new_id, list_filter(f.s, lambda x: x.url = r.url)[1] AS by_url, list_filter(f.s, lambda x: x.title = r.title)[1] AS by_title
          FROM f JOIN r ON r.n = f.n + 1))))),
t AS (SELECT unnest(s, recursive := true) FROM (SELECT s FROM f ORDER BY n DESC LIMIT 1))
SELECT f.position, f.source_id, t.title, t.url FROM f JOIN t ON t.id = f.source_id WHERE f.position IS NOT NULL""")
def source_upsert(t: Tables) -> DataFrame:
    """Pages written as sources, one after the other: the source of each row, as it is after all."""
    from barloom.operators.source_upsert import upserted

    k = F.col("page_id")
    p = t.pages.select("page_id", F.regexp_extract("url", r"^https?://(?:m\.|blog\.)?([^./]*)", 1).alias("host"), "url")
    url = F.regexp_replace("url", "[0-9]+.*$", F.concat((k % 3).cast("string"), F.lit("/")))
    title = F.when(k % 11 == 0, F.concat("host", F.lit(" ["), (k % 3).cast("string"), F.lit("]"))).otherwise(F.col("host"))
    rest = [F.lit("curator").alias("author"), F.lit("website").alias("source_type")]
    rows = p.select(k.alias("position"), title.alias("title"), *rest, F.when(k % 4 != 3, F.concat(url, F.when(k % 2 == 0, "").otherwise("/"))).alias("url"))
    rows = rows.unionByName(p.select((k + 1_000_000).alias("position"), F.lit("other").alias("title"), *rest, url.alias("url")))
    low = F.min("page_id")
    sources = p.where("page_id % 9 = 0").groupBy("host").agg((low + 1).alias("id"), F.when(low % 2 == 1, F.min("url")).alias("url")).select("id", F.col("host").alias("title"), *rest, "url")
    after, ids = upserted(sources, rows)
    return ids.join(after.select(F.col("id").alias("source_id"), "title", "url"), "source_id").select("position", "source_id", "title", "url")


@twin(sections_sql("SELECT doc_id, coalesce(text, '') AS text FROM documents"))
def sections_function(t: Tables) -> DataFrame:
    """Sections by the table function, from SQL."""
    from barloom.sql import register

    register(t.spark)
    rows = t.spark.sql("SELECT doc_id, ordinal AS section_no, chapter, title, content FROM sections(TABLE({docs}))", docs=t.documents.select("doc_id", "text"))
    rows = S.classified(rows, "content")
    return routed(rows.select("*", F.col("c.type").alias("type"), F.col("c.confidence").alias("confidence")).drop("c"))


@twin(r"""
WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS para FROM conversations),
q AS (SELECT *, floor(len(list_filter(regexp_split_to_array(para, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS cost FROM p WHERE para <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k FROM q),
f AS (
  SELECT conv_id, k, para AS chunk, cost AS used, NULL::VARCHAR AS done FROM r WHERE k = 1
  UNION ALL
  SELECT conv_id, k, next, CASE WHEN full_ THEN floor(len(list_filter(regexp_split_to_array(next, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) ELSE used + cost END, CASE WHEN full_ THEN chunk END
  FROM (
    SELECT *, CASE WHEN NOT full_ THEN chunk || chr(10) || chr(10) || para WHEN tail = '' THEN para ELSE tail || chr(10) || chr(10) || para END AS next FROM (
      SELECT *, coalesce(trim(array_to_string(list_filter(sentences, lambda s, i: floor(list_sum(list_transform(sentences[i:], lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')))) * 1.3::DOUBLE) <= 60), ' ')), '') AS tail FROM (
        SELECT r.conv_id, r.k, f.chunk, f.used, r.para, r.cost, f.used + r.cost > 250 AS full_, string_split(regexp_replace(f.chunk, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sentences
        FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)))),
o AS (SELECT conv_id, k, done AS content FROM f WHERE done IS NOT NULL UNION ALL SELECT conv_id, k + 1, chunk FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::INT AS ordinal, sha256(content) AS content_hash, length(content)::INT AS n_chars FROM o""")
def packed_turns(t: Tables) -> DataFrame:
    """Conversations packed into chunks, turn by turn in order, by the table function."""
    from barloom.sql import register

    register(t.spark)
    rows = t.spark.sql("SELECT conv_id, ordinal, content FROM packed_chunks(TABLE(SELECT conv_id, turn, text FROM {turns}) PARTITION BY conv_id ORDER BY turn, size => 250, overlap => 60)", turns=t.conversations)
    return rows.select("conv_id", "ordinal", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("n_chars"))
