"""Queries on functions and lookups that the other files do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.compat import array_length
from barloom.functions import collections as C
from barloom.functions import dates as D
from barloom.functions import numbers as N
from barloom.functions import text as T
from barloom.operators import analytics as A
from barloom.operators import relational as R
from barloom.operators import retrieval as V
from barloom.operators import sections as S
from barloom.plans import rules
from barloom.queries.registry import Tables, twin
from barloom.sources import articles as H
from barloom.sources import web as W


@twin(r"""
SELECT p_partkey, upper(substr(n, 1, 1)) || substr(n, 2, strpos(n, ' ') - 1) || upper(substr(n, strpos(n, ' ') + 1, 1)) || substr(n, strpos(n, ' ') + 2) AS title, n AS plain_title, regexp_replace(n || '/:*', '[^\p{L}\p{N}\-_ ]', '', 'g') AS file, substr(n, 1, 4) AS snippet,
  'RPE ' || (p_size % 10) || '.' || (p_size % 2 * 5) AS effort, (p_size)::VARCHAR || '%' AS pct, p_size || CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '' END || ' kg' AS weight, replace(n, ' ', '_') AS term FROM (SELECT *, p_name AS n FROM part)""")
def label_functions(t: Tables) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_size")
    under = F.replace(n, F.lit(" "), F.lit("_"))
    return t.part.select(
        "p_partkey", T.title_of(under).alias("title"), T.without_page_suffix(F.concat(n, F.when(F.col("p_size") % 2 == 0, " - 12-34").otherwise(" | site"))).alias("plain_title"), T.safe_filename(F.concat(n, F.lit("/:*"))).alias("file"), T.snippet(n, 4).alias("snippet"),
        T.effort_label(k % 10 + k % 2 * 0.5).alias("effort"), T.percent_label(k).alias("pct"), T.weight_label(k + k % 2 * 0.5).alias("weight"), F.replace(T.query_term(F.concat(under, F.lit("_limited"))), F.lit(" "), F.lit("_")).alias("term"),
    )


@twin(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round_even(o_orderkey % 7 * 50000.0031::DOUBLE - o_totalprice, 1) END AS gap, CASE WHEN o_orderkey % 7 <> 0 THEN least(100, round_even(o_totalprice / (o_orderkey % 7 * 50000.0031::DOUBLE) * 100, 0))::INT END AS pct,
  CASE WHEN o_orderkey % 100 / 100.0::DOUBLE < 0.8 - 0.04 THEN 'below' WHEN o_orderkey % 100 / 100.0::DOUBLE > 0.8::DOUBLE + 0.04 THEN 'above' ELSE 'on_target' END AS ratio,
  CASE WHEN o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-06-01' THEN greatest(o_totalprice, 100000.0::DOUBLE) ELSE o_totalprice END AS projected, CASE WHEN o_orderstatus = 'F' THEN 5 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS complexity, 2.0::DOUBLE * pow(2, o_orderkey % 5) AS backoff FROM orders""")
def number_functions(t: Tables) -> DataFrame:
    k, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    gap, pct = N.progress(price, k % 7 * 50000.0031)
    phase = F.when(status == "F", "realization").otherwise("accumulation")
    return t.orders.select(
        k, gap.alias("gap"), pct.alias("pct"), N.ratio_status(k % 100 / 100.0, F.lit(0.8)).alias("ratio"), N.projected_max(price, F.lit(100000.0), phase, F.col("o_orderdate"), F.lit("1995-06-01").cast("timestamp")).alias("projected"),
        rules.max_complexity(F.when(status == "F", "x"), F.when(status == "O", "beginner").otherwise("elite")).alias("complexity"), W.backoff_seconds(k % 5, 2.0).alias("backoff"),
    )


@twin("""
SELECT e.event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0 AS seconds, CASE WHEN event_id % 3 = 0 THEN (ts + INTERVAL 9 HOUR)::DATE ELSE ts::DATE END AS day, nullif(len(CASE WHEN event_id % 4 = 0 THEN [] ELSE [event_id % 4, 1] END), 0)::INT AS n,
  array_to_string((CASE event_id % 3 WHEN 0 THEN [0, 5, 9] WHEN 1 THEN [1, 5, 9] ELSE [2, 5, 9] END)[:2], ',') AS firsts, ts::DATE >= DATE '2024-01-17' AS recent, greatest(1, floor(date_diff('day', DATE '2024-01-05', ts::DATE) / 7.0)::INT + 1) AS week FROM events e""")
def date_functions(t: Tables) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    zone = F.when(k % 3 == 0, "Asia/Tokyo").otherwise("Nowhere/Land")
    some = F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 4, F.lit(1).cast("bigint")))
    return t.events.select(
        k, D.seconds_between(F.lit("2024-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).alias("seconds"), D.today_in(ts, zone, ["Asia/Tokyo"]).alias("day"), array_length(some).alias("n"),
        C.joined(C.first_seen(F.array(k % 3, F.lit(5).cast("bigint")), F.array(F.lit(5).cast("bigint"), F.lit(9).cast("bigint")), most=2)).alias("firsts"), D.within_days(F.to_date(ts), F.lit("2024-01-31").cast("date"), 14).alias("recent"), D.open_week_index(F.lit("2024-01-05").cast("date"), F.to_date(ts)).alias("week"),
    )


@twin("""
WITH r AS (SELECT event_id, event_id % 10 AS v, event_id % 6 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN v <= 5 WHEN 1 THEN v > 2 AND v < 7 WHEN 2 THEN v = 4 WHEN 3 THEN v >= 6 ELSE true END AS holds, CASE WHEN k = 5 THEN 100.0 ELSE k * 1.0 END::DOUBLE AS a, 'none' AS b, CASE k WHEN 4 THEN NULL ELSE '{"a":' || k || '}' END AS parsed FROM r""")
def json_functions(t: Tables) -> DataFrame:
    """Nested comparisons, typed members with defaults, and the JSON of a fenced or chatty reply."""
    v, k = F.col("event_id") % 10, F.col("event_id") % 6
    rule = F.when(k == 0, '{"w": {"lte": 5}}').when(k == 1, '{"w": {"gt": 2, "lt": 7}}').when(k == 2, '{"w": {"eq": 4}}').when(k == 3, '{"w": {"gte": 6}}').when(k == 4, "{}")
    obj = F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))
    reply = F.when(k == 4, "nothing here").when(k % 2 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(F.concat(F.lit("so: "), obj, F.lit(" ok")))
    rows = t.events.select("event_id", C.compares(F.try_parse_json(rule), "$.w", v.cast("double")).alias("holds"), C.with_defaults(F.when(k != 5, obj), "a double, b string", a=100.0, b="none").alias("s"), F.to_json(T.lenient_json(reply)).alias("parsed"))
    return rows.select("event_id", "holds", F.col("s.a").alias("a"), F.col("s.b").alias("b"), "parsed")


@twin("""
SELECT conv_id, string_agg(role || '|' || trim(regexp_replace(text, '\\s+', ' ', 'g')), ';' ORDER BY turn) AS headings FROM conversations GROUP BY 1""".replace("\\\\", "\\"))
def markdown_headings(t: Tables) -> DataFrame:
    """Conversations as markdown, cut at their headings again."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    part = F.concat(F.lit("## "), "role", F.lit("\n"), plain, F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "")
    rows = t.conversations.groupBy("conv_id").agg(text.alias("md"))
    return rows.select("conv_id", F.array_join(F.transform(T.heading_sections(F.col("md")), lambda s: F.concat(s["heading"], F.lit("|"), s["body"])), ";").alias("headings"))


@twin("""
SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND (doc_id % 3 = 0 OR doc_id % 5 = 0) AND (doc_id % 4 = 0 OR doc_id % 4 = 1 OR doc_id % 4 = 2) AND doc_id % 3 <> 1 AND doc_id % 2 = 0""")
def metadata_filter(t: Tables) -> DataFrame:
    """Type, topics, level, density and numbers together."""
    k = F.col("doc_id")
    topics = F.array_compact(F.array(F.when(k % 3 == 0, "a"), F.when(k % 5 == 0, "b"), F.lit("c")))
    level = F.when(k % 4 == 1, "all").when(k % 4 == 2, "elite").when(k % 4 == 3, "beginner")
    density = F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").otherwise("medium")
    rows = t.documents.select("doc_id", F.col("lang").alias("chunk_type"), topics.alias("topics"), level.alias("athlete_level"), density.alias("information_density"), (k % 2 == 0).alias("contains_specific_numbers"))
    return rows.where(V.metadata_filter(["en", "fr"], ["a", "b"], "elite", "medium", True)).select("doc_id")


@twin("""
SELECT event_id AS id FROM events WHERE event_id % 4 IN (0, 1, 3) ORDER BY event_id % 50 DESC, event_id LIMIT 20""")
def active_principles(t: Tables) -> DataFrame:
    """Principles whose conditions admit phase and level, the most important first."""
    k = F.col("event_id") % 4
    text = F.when(k == 1, '{"phase": "a", "athlete_level": ["x", "y"]}').when(k == 2, '{"phase": "b"}').when(k == 3, '{"athlete_level": "x"}')
    rows = t.events.select(F.col("event_id").alias("id"), F.try_parse_json(text).alias("condition"), (F.col("event_id") % 50).alias("priority"))
    return V.active_principles(rows, "a", "x").select("id")


@twin("""
SELECT p_partkey AS id FROM part WHERE p_size % 7 BETWEEN 2 AND 4 AND p_size % 2 = 0 AND p_size % 3 IN (0, 1) ORDER BY p_size NULLS LAST, p_partkey LIMIT 3""")
def matching_templates(t: Tables) -> DataFrame:
    """Up to three templates with the phase, the level and about the sessions a week."""
    k = F.col("p_size")
    rows = t.part.select(F.col("p_partkey").alias("id"), k.alias("source_id"), (k % 7).alias("sessions_per_week"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("phases_included"), F.when(k % 3 == 0, "any").when(k % 3 == 1, "elite").otherwise("beginner").alias("athlete_level"))
    return V.matching_templates(rows, "a", "elite", 3).select("id")


@twin("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END DESC, p_name || p_partkey) AS rn FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size <= 20 AND p_partkey % 3 <> 0) SELECT p_partkey AS id, p_type FROM r WHERE rn <= 10""")
def fault_exercises(t: Tables) -> DataFrame:
    """The simplest exercises of each family against a fault."""
    k = F.col("p_partkey")
    faults = F.when(k % 3 == 0, F.array(F.lit("z"))).when(k % 2 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("b")))
    rows = t.part.select(k.alias("id"), F.concat("p_name", k.cast("string")).alias("name"), F.col("p_type").alias("movement_family"), F.col("p_size").alias("complexity"), faults.alias("faults_addressed"))
    return V.fault_exercises(rows, ["a", "b"], ["ECONOMY", "PROMO"], 20).select("id", F.col("movement_family").alias("p_type"))


@twin("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'ing') ORDER BY id LIMIT 100")
def search_names(t: Tables) -> DataFrame:
    return V.search_names(t.part.withColumnRenamed("p_partkey", "id"), "p_name", ["RED", "ing"], 100).select("id")


@twin("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'the ' || p_name || ' x' WHEN p_partkey % 3 = 1 THEN upper(split_part(p_name, ' ', 1)) ELSE p_name END AS x FROM part),
u AS (SELECT x FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE lower(n.name) = lower(a.x))), m AS (SELECT u.x, n.name, row_number() OVER (PARTITION BY u.x ORDER BY n.name) AS rn FROM u LEFT JOIN n ON contains(lower(n.name), lower(u.x)) OR contains(lower(u.x), lower(n.name)))
SELECT x AS exercise_name, coalesce(string_agg(name, ',' ORDER BY name), '') AS suggestions FROM m WHERE rn <= 3 GROUP BY 1""")
def name_suggestions(t: Tables) -> DataFrame:
    """Known names near unknown ones."""
    k, n = F.col("p_partkey"), F.col("p_name")
    rows = t.part.select(F.when(k % 3 == 0, F.concat(F.lit("the "), n, F.lit(" x"))).when(k % 3 == 1, F.upper(F.split_part(n, F.lit(" "), F.lit(1)))).otherwise(n).alias("exercise_name"))
    out = V.suggestions(rows, t.part.select(n.alias("name")).distinct())
    return out.select("exercise_name", F.array_join("suggestions", ",").alias("suggestions"))


@twin("""
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN (SELECT min(x.p_partkey) FROM part x WHERE x.p_name = part.p_name) END AS exercise_id FROM part""")
def dictionary_ids(t: Tables) -> DataFrame:
    """Ids of names without regard to case; unknown ones have none."""
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "unheard of").otherwise(F.upper("p_name")).alias("asked"))
    return R.dictionary_ids(rows, "asked", t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("p_partkey", "exercise_id")


@twin("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND lower(o_orderpriority) = lower('5-low')""")
def array_parameter(t: Tables) -> DataFrame:
    """Membership in an array parameter, equality without case, and a projection that leaves columns out."""
    rows = R.any_of(t.orders, "o_custkey", t.customer.where("c_acctbal > 9000"), "c_custkey").where(R.same_name(F.col("o_orderpriority"), F.lit("5-LOW")))
    return R.without(rows, "o_totalprice", "o_orderdate", "o_orderpriority", "no_such_column")


@twin("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 200")
def multi_key_order(t: Tables) -> DataFrame:
    return R.ordered_top(t.orders, 200, F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_totalprice")


@twin("SELECT conv_id, turn, role FROM conversations WHERE turn < 2")
def page_prefix(t: Tables) -> DataFrame:
    return R.prefix_per(t.conversations, "turn", 2).select("conv_id", "turn", "role")


@twin("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE user_id = 3 AND event_type = 'error'")
def point_lookup(t: Tables) -> DataFrame:
    rows = R.lookup(t.events, ["props"], user_id=3, event_type="error")
    return rows.select("event_id", F.try_variant_get("props", "$.k", "int").alias("k"))


@twin("SELECT 1 AS alive")
def liveness(t: Tables) -> DataFrame:
    from barloom.session import alive

    return alive(t.spark)


@twin("SELECT p_partkey, 'small_ring' AS name, p_size * 1.5::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'red_widget', 2.0 FROM part")
def snapshot_values(t: Tables) -> DataFrame:
    """A JSON map of maxima as rows."""
    text = F.to_json(F.create_map(F.lit("Small Ring"), F.col("p_size") * 1.5, F.lit("Red Widget"), F.lit(2.0)))
    return A.snapshot_rows(t.part.select("p_partkey", text.alias("maxes")), ["p_partkey"], "maxes").select("p_partkey", "name", "value")


#: Main text of the tables' pages, each of which has one article element with paragraphs and headings: blocks end lines, two entities occur.
STRIPPED_SQL = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
DECODED_SQL = "regexp_replace(replace({x}, '&quot;', chr(34)), '&amp;?', '&', 'g')"
MAIN_TEXT_SQL = f"""art AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS head FROM pages),
plain AS (SELECT page_id, {DECODED_SQL.format(x="regexp_replace(regexp_replace(regexp_replace(art, '</?(p|h1)>', chr(10) || chr(10), 'g'), '<br>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')")} AS plain FROM art),
body AS (SELECT page_id, {STRIPPED_SQL.format(x="regexp_replace(regexp_replace(regexp_replace(plain, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM plain)"""
CONTAINS = " OR ".join(f"contains(lower(source), '{w}')" for w in ("web",))


@twin(f"""
SELECT doc_id, CASE WHEN {CONTAINS} THEN 'web_article' WHEN contains(lower(source), 'a') THEN 'soviet' ELSE 'programming' END AS profile,
  CASE WHEN n > 3000 THEN 1100 WHEN n > 1000 THEN 900 ELSE 500 END AS size, CASE WHEN n > 3000 THEN 250 WHEN n > 1000 THEN 200 ELSE 100 END AS overlap
FROM (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)""")
def profile_and_size(t: Tables) -> DataFrame:
    """Chunk sizes by known titles, and by the words of an article."""
    pair = S.web_size(T.word_count(F.col("text")))
    return t.documents.select("doc_id", S.profile_of(F.col("source"), {"web": "web_article", "a": "soviet"}).alias("profile"), pair["size"].alias("size"), pair["overlap"].alias("overlap"))


@twin(f"""
WITH {MAIN_TEXT_SQL},
l AS (SELECT page_id, head, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(art, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: string_split({DECODED_SQL.format(x="x")}, chr(10)))), lambda x: {STRIPPED_SQL.format(x="x")}), lambda x: x <> '') AS lines FROM art)
SELECT page_id, CASE WHEN length(lines[1]) >= 6 THEN lines[1] ELSE {STRIPPED_SQL.format(x=DECODED_SQL.format(x="head"))} END AS title, CASE WHEN regexp_matches(lines[2], '^[A-Z][a-zA-Z\\s\\-\\.]{{3,40}}$') THEN lines[2] ELSE 'nobody' END AS author, length(body) AS n_chars, sha256(body) AS text_hash, CASE WHEN length(body) >= 200 THEN 'ok' ELSE 'skip' END AS status
FROM l JOIN body USING (page_id)""")
def live_articles(t: Tables) -> DataFrame:
    """Every page read as a live article: title, author, text and status."""
    rows = H.articles(t.pages, author="nobody")
    return rows.select("page_id", "title", "author", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"), "status")


@twin("""
SELECT page_id, 'T' || page_id || ' heading' AS title, 'Jane Doe' AS author, CASE WHEN page_id % 3 = 0 THEN 'skip' ELSE 'ok' END AS status, CASE WHEN page_id % 3 = 0 THEN 'retry' ELSE 'ok' END AS archived FROM pages""")
def article_status(t: Tables) -> DataFrame:
    """Containers, titles, authors and what is too short, live and archived."""
    k = F.col("page_id")
    body = F.concat(F.lit("<p>T"), k.cast("string"), F.lit(" heading</p><p>Jane Doe</p><p>"), F.when(k % 3 == 0, "short").otherwise(F.repeat(F.lit("words "), 60)), F.lit("</p>"))
    tag = F.when(k % 2 == 0, '<div class="x article-body">').otherwise('<div class="post-content article_text">')
    html = F.concat(F.lit("<html><body><nav>menu</nav>"), tag, body, F.lit('</div><aside>more</aside><h1 class="entry-title">T'), k.cast("string"), F.lit(" heading</h1></body></html>"))
    pages = t.pages.select("page_id", "url", html.alias("html"))
    live = H.articles(pages, author="nobody").select("page_id", "title", "author", "status")
    old = H.articles(pages.withColumn("html", F.replace("html", F.lit("x article-body"), F.lit("entry-content"))), archived=True).select(k.alias("__p"), F.col("status").alias("archived"))
    return live.join(old, k == F.col("__p")).drop("__p")


@twin("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 6 WHEN c_custkey % 4 = 1 THEN 2 ELSE 0 END AS duration_weeks, CASE WHEN c_custkey % 4 = 1 THEN 3 ELSE 0 END AS sessions_per_week, CASE WHEN c_custkey % 2 = 0 THEN 'Part A (' || c_name || ')' ELSE 'Program from ' || c_name END AS name FROM customer""")
def inferred_dimensions(t: Tables) -> DataFrame:
    """Weeks and sessions of programmes that do not say them."""
    k = F.col("c_custkey") % 4
    week = lambda n: F.struct(F.lit(1).alias("week"), F.array(*[F.lit("s")] * n).cast("array<string>").alias("sessions"))
    weeks = F.when(k == 1, F.array(week(3), week(1))).otherwise(F.array().cast("array<struct<week:int,sessions:array<string>>>"))
    rows = t.customer.select("c_custkey", F.when(k == 0, 6).when(k == 2, 0).alias("duration_weeks"), F.lit(None).cast("int").alias("sessions_per_week"), weeks.alias("weeks"), "c_name")
    out = S.inferred_dimensions(rows)
    return out.select("c_custkey", "duration_weeks", "sessions_per_week", S.template_name(F.when(F.col("c_custkey") % 2 == 0, " Part A "), F.col("c_name")).alias("name"))


@twin("""
SELECT doc_id, id, text_md5 FROM (SELECT doc_id, 'r' || doc_id % 10 AS id, md5(substr(text, 1, 20)) AS text_md5, row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def extracted_rows(t: Tables) -> DataFrame:
    """Rows that a hook finds in windows of a text; of equal names the first window's."""

    def hook(window: str) -> str:
        import hashlib
        import json

        return "```json\n" + json.dumps([{"name": "n", "md5": hashlib.md5(window[:20].encode()).hexdigest()}, {"name": "  "}, None]) + "\n```"

    rows = S.extracted(t.documents.select(F.col("doc_id").alias("id"), "text"), "text", hook, "name: string, md5: string")
    return rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("r"), (F.col("id") % 10).cast("string")).alias("id"), F.col("row.md5").alias("text_md5"))


@twin("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) > 100 THEN CASE WHEN doc_id % 6 = 0 THEN 'prose' ELSE 'principle' END ELSE 'mixed' END AS type, CASE WHEN doc_id % 2 = 0 AND length(text) > 100 THEN CASE WHEN doc_id % 6 = 0 THEN 0.5 ELSE 0.9 END ELSE CASE WHEN doc_id % 2 = 0 THEN 0.55 ELSE 0.8 END END::DOUBLE AS confidence FROM documents")
def adjudicated_sections(t: Tables) -> DataFrame:
    """Unsure sections ask a hook; a hook that fails means prose."""

    def hook(text: str, title: str) -> tuple[str, float]:
        if int(title) % 6 == 0:
            raise RuntimeError("no answer")
        return "principle", 0.9

    rows = t.documents.select("doc_id", "text", F.col("doc_id").cast("string").alias("title"), F.lit("mixed").alias("type"), F.when(F.col("doc_id") % 2 == 0, 0.55).otherwise(0.8).alias("confidence"))
    return S.adjudicated(rows, "text", hook, "title").select("doc_id", "type", "confidence")


@twin("""
SELECT page_id, (page_id % 3)::INT AS page, CASE WHEN page_id // 3 % 4 = 3 THEN '' ELSE 'p' || page_id END AS text FROM pages""")
def batched_pages(t: Tables) -> DataFrame:
    """Page images read some at a time; a reply is split into its pages, a failed call leaves them empty."""
    from barloom.sources.files import batched_pages as read

    def service(images: list[bytes]) -> str:
        if int(images[0]) // 3 % 4 == 3:
            raise RuntimeError("no answer")
        return "".join(f"=== Page {i + 1} ===\np{x.decode()}\n" for i, x in enumerate(images))

    k = F.col("page_id")
    rows = t.pages.select(F.floor(k / 3).cast("string").alias("path"), (k % 3).cast("int").alias("page"), k.cast("string").cast("binary").alias("image"))
    out = read(rows, service)
    return out.select((F.col("path").cast("long") * 3 + F.col("page")).alias("page_id"), "page", "text")
