"""The registered queries of the operators over the synthetic tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, debruijn, divergence, embeddings, exact_dedup, lm, mixing, prefix_doubling, quality, rules, trie, warc
from ._io import table


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("payload", "url")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.withColumn("rate", F.round("rate", 6))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_doubling.removed(table(spark, sf_dir, "documents"))


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removed(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ranks_file(), keep=["doc_id"], ids=False, pattern=pattern())


def op11_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).drop("posterior")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rp_forest": op1_rp_forest,
    "op2_lm_score": op2_lm_score,
    "op3_warc": op3_warc,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_bagminhash": op5_bagminhash,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_prefix_doubling": op8_prefix_doubling,
    "op9_debruijn": op9_debruijn,
    "op10_bpe": op10_bpe,
    "op11_weak_rules": op11_weak_rules,
    "op12_divergence": op12_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op4_poisson_mix": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(coalesce(length(text), 0), 1))::BIGINT AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM sizes) * (SELECT sum(size) FROM sizes)::DOUBLE / size AS rate FROM sizes),
parts AS (
  SELECT source, rate, greatest(1, ceil(rate / 8.0))::INT AS m FROM rates),
draws AS (
  SELECT d.doc_id, p.rate / p.m AS mean,
         (('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i::VARCHAR), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.m + 1)) AS t(i)),
steps AS (
  SELECT doc_id, mean, u, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM draws
  UNION ALL
  SELECT doc_id, mean, u, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps WHERE u > cdf AND k < 48),
counts AS (
  SELECT doc_id, sum(k)::INT AS n FROM (SELECT doc_id, u, max(k) AS k FROM steps GROUP BY doc_id, u) GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c::INT AS copy_no, round(r.rate, 6) AS rate,
       md5('mix-1|' || d.doc_id::VARCHAR || '|copy|' || c::VARCHAR) AS shuffle_key
FROM documents d JOIN counts USING (doc_id) JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(0, counts.n)) AS t(c)
""",
    "op1_rp_forest": """
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM u WHERE ok),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
""",
    "op8_prefix_doubling": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
b AS (SELECT doc_id, p, n, substr(x, (2 * p + 1)::INT, 2) AS byte, CASE WHEN p + 100 <= n THEN md5(substr(x, (2 * p + 1)::INT, 200)) END AS h FROM d, unnest(range(0, n)) AS t(p)),
m AS (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS hit FROM b),
g AS (SELECT doc_id, p, byte, coalesce(max(CASE WHEN hit THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) >= p - 99, false) AS gone FROM m),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM g),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS rest FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op9_debruijn": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, p, ws[p] AS word, CASE WHEN p + 49 <= len(ws) THEN md5(array_to_string(ws[p:p + 49], ' ')) END AS h FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
m AS (SELECT *, h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id AS hit FROM w),
g AS (SELECT doc_id, p, word, coalesce(max(CASE WHEN hit THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) >= p - 49, false) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS rest FROM g GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op7_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op11_weak_rules": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, p, ws[p:p + 2] AS three FROM w, unnest(range(1, len(ws) - 1)) AS t(p)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
k AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM r, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct_words,
    length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_ascii_letters,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
    len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letter_words
  FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
v AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed, [{", ".join(r.sql() for r in rules.RULES)}] AS v FROM c),
pat AS (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v),
em AS (
  SELECT 0 AS i, {rules.START[0]}::DOUBLE AS good, list_transform(range({len(rules.RULES)}), lambda x: {rules.START[1]}::DOUBLE) AS a, list_transform(range({len(rules.RULES)}), lambda x: {rules.START[2]}::DOUBLE) AS b
  UNION ALL
  SELECT i + 1, any_value((up + own * {rules.START[0]}) / (up + down + own)), list((gu + own * {rules.START[1]}) / (gv + own) ORDER BY k), list((bd + own * {rules.START[2]}) / (bv + own) ORDER BY k)
  FROM (
    SELECT i, k, {rules.WEIGHT} * greatest(sum(n), 1) AS own, sum(p * n) AS up, sum((1 - p) * n) AS down, coalesce(sum(p * n) FILTER (v[k] > 0), 0) AS gu, coalesce(sum(p * n) FILTER (v[k] <> 0), 0) AS gv,
      coalesce(sum((1 - p) * n) FILTER (v[k] < 0), 0) AS bd, coalesce(sum((1 - p) * n) FILTER (v[k] <> 0), 0) AS bv
    FROM (
      SELECT i, v, n, 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, {len(rules.RULES) + 1}), lambda j: CASE WHEN v[j] = 0 OR a[j] + b[j] <= 1 THEN 0 WHEN v[j] > 0 THEN ln(a[j] / (1 - b[j])) ELSE ln((1 - a[j]) / b[j]) END))))) AS p
      FROM em, pat WHERE i < {rules.ROUNDS}), unnest(range(1, {len(rules.RULES) + 1})) AS t(k) GROUP BY i, k) GROUP BY i),
post AS (
  SELECT v, 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, {len(rules.RULES) + 1}), lambda j: CASE WHEN v[j] = 0 OR a[j] + b[j] <= 1 THEN 0 WHEN v[j] > 0 THEN ln(a[j] / (1 - b[j])) ELSE ln((1 - a[j]) / b[j]) END))))) AS p
  FROM em, pat WHERE i = {rules.ROUNDS})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND p >= {rules.THRESHOLD} AS kept
FROM v JOIN post USING (v)
""",
    "op12_divergence": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT row_number() OVER () AS r, lang, source, ts FROM d),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM w),
k AS (SELECT lang, term, count(*) AS n_lang FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
n AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n_lang) OVER (PARTITION BY lang, source) AS total_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM n),
p AS (SELECT lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + {divergence.SMOOTH})) // (total + {divergence.SMOOTH} * v) AS p, 1 + ({divergence.SCALE}::HUGEINT * (n_lang + {divergence.SMOOTH})) // (total_lang + {divergence.SMOOTH} * v) AS q FROM s),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM y WHERE part = 'pair' OR rank <= {divergence.TOP}
""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn FROM conversations),
p AS (SELECT c, text, digest, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS pos FROM t),
z AS (SELECT c, c - c % 5 AS base, max(pos) AS total, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: unicode(substr(c::VARCHAR, i::INT, 1))::UBIGINT) AS codes FROM p GROUP BY c),
v AS (
  SELECT c, base, total, xor(list_reduce(list_prepend(4294967295::UBIGINT, codes), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 9 AS h FROM z),
b AS (
  SELECT v.c, p.pos AS d, p.digest, p.text FROM v JOIN p ON p.c = v.base AND p.pos <= v.h
  UNION ALL
  SELECT v.c, least(v.h, coalesce(o.total, 0)) + p.pos - v.h, p.digest, p.text FROM v JOIN p ON p.c = v.c AND p.pos > v.h LEFT JOIN v o ON o.c = v.base
  UNION ALL
  SELECT c, 0, '', '' FROM v),
n AS (SELECT c, d, strlen(text) AS bytes, sha256(string_agg(digest, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS name, max(d) OVER (PARTITION BY c) AS last FROM b),
q AS (SELECT *, lag(name) OVER (PARTITION BY c ORDER BY d) AS above FROM n),
k AS (SELECT d, name, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '') AS ends FROM q GROUP BY d, name),
m AS (SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM k WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN m USING (d, name)),
u AS (SELECT DISTINCT a.d, a.name, b.d AS d2, b.name AS name2 FROM q a JOIN q b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT u.d, u.name, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved FROM u JOIN w ON w.d = u.d2 AND w.name = u.name2 GROUP BY 1, 2)
SELECT w.conv_id, w.d::BIGINT AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s USING (d, name) LEFT JOIN w o ON o.d = w.d - 1 AND o.name = w.above
""",
}
