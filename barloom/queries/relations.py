"""Joins, windows, picks, set operations and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import asc, desc
from barloom.functions import collections as C
from barloom.functions import numbers as N
from barloom.functions import text as T
from barloom.operators import merge as M
from barloom.operators import relational as R
from barloom.plans import rules
from barloom.queries.registry import Tables, twin

ZONE_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in z) + ")" for z in rules.ZONES)


@twin(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, zone, optimal FROM (SELECT *, l_quantity * 2 AS pct FROM lineitem) l
LEFT JOIN (VALUES {ZONE_ROWS}) z(zone, low, high, a, b, optimal, tl, th) ON pct >= low AND (high IS NULL OR pct < high)""")
def zone_band_join(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("pct", F.col("l_quantity") * 2)
    return R.band_join(rows, "pct", rules.zones(t.spark)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "zone", "optimal")


@twin("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, name FROM lineitem LEFT JOIN (VALUES ('a', 1, 10), ('b', 10, 20), ('c', 20, 30)) z(name, low, high) ON l_quantity BETWEEN low AND high""")
def zone_between_inclusive(t: Tables) -> DataFrame:
    """A value on a boundary matches both bands."""
    bands = t.spark.createDataFrame([("a", 1, 10), ("b", 10, 20), ("c", 20, 30)], "name string, low int, high int")
    return R.band_join(t.lineitem, "l_quantity", bands, inclusive=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "name")


@twin("""
SELECT c_custkey, c_name AS athlete, o_orderkey AS program, l_linenumber AS entry, p_name AS exercise, coalesce(p_brand, '(none)') AS brand FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def left_chain_export(t: Tables) -> DataFrame:
    o, line, p = t.orders.where("o_orderstatus = 'P'"), t.lineitem, t.part
    out = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select("c_custkey", F.col("c_name").alias("athlete"), F.col("o_orderkey").alias("program"), F.col("l_linenumber").alias("entry"), F.col("p_name").alias("exercise"), F.coalesce("p_brand", F.lit("(none)")).alias("brand"))


@twin("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unlogged_anti(t: Tables) -> DataFrame:
    return R.missing_from(t.orders, t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderdate")


@twin("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45))")
def semi_in(t: Tables) -> DataFrame:
    big = t.lineitem.join(t.part.where("p_size > 45"), F.col("p_partkey") == F.col("l_partkey"))
    orders = R.present_in(t.orders, big, F.col("l_orderkey") == F.col("o_orderkey"))
    return R.present_in(t.customer, orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@twin("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def not_exists(t: Tables) -> DataFrame:
    return R.missing_from(t.part, t.lineitem.where("l_returnflag = 'R'"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey")


@twin("""
WITH g AS (SELECT doc_id, source, sha256(text) AS h FROM documents)
SELECT doc_id FROM g WHERE doc_id NOT IN (SELECT a.doc_id FROM g a JOIN g b ON a.h = b.h AND a.source = b.source AND a.doc_id > b.doc_id)""")
def dup_self_theta(t: Tables) -> DataFrame:
    """The delete by a self-join a.id > b.id, as a window that keeps the lowest id."""
    rows = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return M.dedup_keep_lowest(rows, ["source", "h"], "doc_id", null_safe=False).select("doc_id")


@twin("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cn.n_name AS customer_nation, sn.n_name AS supplier_nation FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE l_quantity > 45""")
def dim_twice(t: Tables) -> DataFrame:
    cn, sn = t.nation.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("customer_nation")), t.nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supplier_nation"))
    rows = t.lineitem.where("l_quantity > 45").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(cn, F.col("ck") == F.col("c_nationkey")).join(sn, F.col("sk") == F.col("s_nationkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "customer_nation", "supplier_nation")


@twin("""
SELECT p_partkey, p_size, arg_min(k, abs(k - p_size) * 1000 + k)::INT AS sessions FROM part, (VALUES (3), (4), (5), (20), (30)) v(k) GROUP BY p_partkey, p_size""")
def nearest_bucket(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([(k,) for k in (3, 4, 5, 20, 30)], "sessions int")
    return R.nearest(t.part.select("p_partkey", "p_size"), "p_size", table, "sessions")


@twin("""
SELECT n_nationkey, n_name, count(s_suppkey) AS n, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def nested_children(t: Tables) -> DataFrame:
    """Children stitched into their parents as one ordered array."""
    kids = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    out = R.nested(t.nation, kids, ["n_nationkey"], ["s_suppkey"], "kids")
    return out.select("n_nationkey", "n_name", F.size("kids").cast("long").alias("n"), F.array_join(F.transform("kids", lambda k: k["s_name"]), ",").alias("names"))


@twin("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE rn = 1""")
def status_priority_top1(t: Tables) -> DataFrame:
    first = F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    return R.keep_first(t.orders, ["o_custkey"], first, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@twin("""
WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey) AS rn FROM part WHERE p_size <= 25) SELECT p_brand, p_partkey, p_retailprice FROM r WHERE rn <= 10""")
def topn_per_family(t: Tables) -> DataFrame:
    return R.top_per(t.part.where("p_size <= 25"), ["p_brand"], 10, asc("p_size"), desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_retailprice")


@twin("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS place,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END ASC NULLS LAST, o_orderkey) AS up FROM orders""")
def nulls_order(t: Tables) -> DataFrame:
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(v.desc_nulls_last(), "o_orderkey")).alias("place"), F.row_number().over(w.orderBy(asc(v), "o_orderkey")).alias("up"))


@twin("SELECT event_id, user_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS keeper FROM events")
def first_value_keeper(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return t.events.select("event_id", "user_id", F.first("event_id").over(w).alias("keeper"))


@twin("""
WITH k AS (SELECT user_id, event_type, event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS keep FROM events)
SELECT keep AS log_id, count(*) AS children FROM k GROUP BY keep""")
def merged_duplicate_logs(t: Tables) -> DataFrame:
    """Logs that share a key are merged into the first; their children follow."""
    logs = t.events.select("event_id", F.concat_ws("|", "user_id", "event_type").alias("session_id"))
    children = t.events.select(F.col("event_id").alias("child_id"), F.col("event_id").alias("log_id"))
    kept, moved = M.repointed(logs, children, "session_id", "event_id", "log_id")
    return moved.join(kept, F.col("log_id") == F.col("event_id"), "left_semi").groupBy("log_id").agg(F.count(F.lit(1)).alias("children"))


@twin("""
SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS through FROM orders""")
def running_budget(t: Tables) -> DataFrame:
    out = R.running(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "before", "through")
    return out.select("o_orderkey", F.round("before", 2).alias("before"), F.round("through", 2).alias("through"))


@twin("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations""")
def ffill_headers(t: Tables) -> DataFrame:
    out = R.forward_filled(t.conversations, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "last_user")
    return out.select("conv_id", "turn", "last_user")


@twin("""
SELECT doc_id, i::INT AS window_no, sha256(substr(text, (i * 1500 + 1)::INT, 2000)) AS window_hash FROM documents,
  unnest(range(0, CASE WHEN length(text) <= 2000 THEN 1 ELSE (length(text) - 1) // 1500 + 1 END)) AS u(i)""")
def text_windows(t: Tables) -> DataFrame:
    out = R.windows(t.documents.select("doc_id", "text"), "text", 2000, 1500)
    return out.select("doc_id", "window_no", F.sha2("window_text", 256).alias("window_hash"))


@twin("""
WITH o AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS purpose, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS id, p_type AS purpose, p_size + 1 AS size FROM part WHERE p_partkey % 3 <> 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.purpose WHEN o.id IS NULL THEN n.purpose ELSE coalesce(nullif(o.purpose, ''), n.purpose) END AS purpose,
  CASE WHEN n.id IS NULL THEN o.size ELSE n.size END AS size FROM o FULL OUTER JOIN n ON o.id = n.id""")
def upsert_coalesce(t: Tables) -> DataFrame:
    old = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("purpose"), F.col("p_size").alias("size"))
    new = t.part.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("purpose"), (F.col("p_size") + 1).alias("size"))
    return M.upsert(old, new, ["id"], {"purpose": M.curated})


@twin("""
WITH old AS (SELECT p_brand AS s, p_name AS n FROM part WHERE p_partkey < 500),
r AS (SELECT p_partkey AS id, CASE WHEN p_size > 48 THEN NULL ELSE p_brand END AS s, p_name AS n FROM part WHERE p_partkey >= 500),
f AS (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY id) AS rn FROM r)
SELECT id FROM f WHERE (rn = 1 OR s IS NULL) AND NOT EXISTS (SELECT 1 FROM old WHERE old.s = f.s AND old.n = f.n)""")
def insert_ignore_pairs(t: Tables) -> DataFrame:
    """Insert-ignore on two columns; a null in the key never conflicts."""
    old = t.part.where("p_partkey < 500").select(F.col("p_brand").alias("s"), F.col("p_name").alias("n"))
    rows = t.part.where("p_partkey >= 500").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 48, F.col("p_brand")).alias("s"), F.col("p_name").alias("n"))
    return M.insert_ignore(old, rows, ["s", "n"], ["id"]).select("id")


@twin("""
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN NULL ELSE p_brand END AS s, md5(p_name || p_type) AS h FROM part), o AS (SELECT DISTINCT s, h FROM r JOIN lineitem ON l_partkey = id WHERE l_quantity > 49),
f AS (SELECT *, row_number() OVER (PARTITION BY s, h ORDER BY id) AS rn FROM r) SELECT id FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.s IS NOT DISTINCT FROM f.s AND o.h = f.h)""")
def insert_ignore_null_safe(t: Tables) -> DataFrame:
    """Parts are added unless their key, null keys included, is among those of parts sold in large quantities."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("s"), F.md5(F.concat("p_name", "p_type")).alias("h"))
    old = rows.join(t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id", "left_semi").select("s", "h")
    return M.insert_ignore(old, rows, ["s", "h"], ["id"], null_safe=True).select("id")


@twin("""
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN NULL ELSE o_orderkey END AS session_id,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderstatus = 'P') AS cascaded FROM orders""")
def delete_cascade(t: Tables) -> DataFrame:
    """Deleting programmes: references go null, and the rows below each are counted."""
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("gone_id"))
    (below,) = M.cascade(gone, "gone_id", [(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_orderkey")])
    counts = below.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    out = M.unlinked(t.orders.select("o_orderkey", F.col("o_orderkey").alias("session_id")), gone, "session_id", "gone_id")
    return out.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "session_id", F.coalesce("n", F.lit(0)).cast("long").alias("cascaded"))


@twin("""
WITH s AS (SELECT o_custkey AS athlete_id, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'draft' ELSE 'done' END AS status FROM orders),
m AS (SELECT *, status = 'draft' AND o_orderkey % 2 = 0 AS go FROM s), w AS (SELECT *, bool_or(go) OVER (PARTITION BY athlete_id) AS any_go FROM m)
SELECT athlete_id, o_orderkey, CASE WHEN go THEN 'active' WHEN any_go AND status = 'active' THEN 'superseded' ELSE status END AS status FROM w""")
def status_machine(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "draft").otherwise("done")
    rows = t.orders.select(F.col("o_custkey").alias("athlete_id"), "o_orderkey", status.alias("status"))
    return M.activated(rows, F.col("o_orderkey") % 2 == 0)


@twin("""
WITH m AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_partkey, n.q AS weight, m.q AS previous, m.q IS NULL OR n.q > m.q AS is_pr FROM n LEFT JOIN m USING (l_partkey)""")
def personal_records(t: Tables) -> DataFrame:
    best = lambda flag, name: t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.max("l_quantity").alias(name))
    out = best("R", "weight").join(best("A", "previous"), "l_partkey", "left")
    return out.withColumn("is_pr", M.personal_best(F.col("previous"), F.col("weight")))


@twin("""
WITH g AS (SELECT user_id, event_type, min(ts) AS started_at, max(ts) AS updated_at, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1, 2)
SELECT user_id || '/' || event_type AS run_id, started_at, updated_at, value, date_diff('microsecond', started_at, updated_at) / 1000000.0 AS duration_seconds FROM g""")
def run_ledger_state(t: Tables) -> DataFrame:
    return M.latest_state(t.events.select(F.concat_ws("/", "user_id", "event_type").alias("run_id"), "ts", "value"))


@twin("""
SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT k, 'both' FROM (SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier)
UNION ALL SELECT k, 'pending' FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def set_ops(t: Tables) -> DataFrame:
    as_id = lambda df, c, kind: df.select(F.col(c).cast("long").alias("id"), F.lit(kind).alias("kind"))
    a, b = as_id(t.customer.where("c_acctbal > 5000"), "c_custkey", "customer"), as_id(t.supplier.where("s_acctbal > 5000"), "s_suppkey", "supplier")
    both = t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))
    pending = t.orders.select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.select(F.col("l_orderkey").alias("k")))
    return a.unionByName(b).unionByName(as_id(both, "k", "both")).unionByName(as_id(pending, "k", "pending"))


@twin("""
WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS r FROM embeddings),
l AS (SELECT id, 0 AS source_no, r FROM a WHERE r <= 2 UNION ALL SELECT id, 1, r FROM b WHERE r <= 20), d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_no, r) AS k FROM l)
SELECT id, source_no::INT AS source_no FROM d WHERE k = 1 ORDER BY source_no, r, id LIMIT 4""")
def quota_merge(t: Tables) -> DataFrame:
    def ranked(i: int, n: int) -> DataFrame:
        top = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[i].alias("s")).orderBy(F.desc("s"), "id").limit(n)
        return top.select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("r"))

    return R.quota_merge(ranked(0, 2), ranked(1, 20), "id", "r", 2, 4).select("id", "source_no")


@twin("""
WITH s AS (SELECT o_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS a, list(DISTINCT (l_quantity::INT) % 8 ORDER BY (l_quantity::INT) % 8) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added,
  array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed, list_has_any(a, b) AS overlap, list_has_all(a, [1, 2]) AS has_both, coalesce(list_sum(a), 0)::BIGINT AS total FROM s""")
def array_sets(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"), F.array_sort(F.collect_set((F.col("l_quantity").cast("int") % 8))).alias("b"))
    added, removed = C.set_changes(F.col("a"), F.col("b"))
    need = F.array(F.lit(1), F.lit(2))
    return rows.select("o_orderkey", C.joined(C.union_sorted(F.col("a"), F.col("b"))).alias("both"), C.joined(F.array_sort(added)).alias("added"), C.joined(F.array_sort(removed)).alias("removed"), C.overlaps(F.col("a"), F.col("b")).alias("overlap"), C.contains_all(F.col("a"), need).alias("has_both"), C.total(F.col("a")).alias("total"))


@twin(r"""
SELECT p_partkey, CASE WHEN regexp_matches(x, '^[=+\-@\t\r]') THEN '''' || x ELSE x END AS safe FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '=' || p_name WHEN 1 THEN '+' || p_name WHEN 2 THEN '-' || p_name WHEN 3 THEN '@' || p_name WHEN 4 THEN chr(9) || p_name ELSE p_name END AS x FROM part)""")
def csv_safe(t: Tables) -> DataFrame:
    k, name = F.col("p_size") % 6, F.col("p_name")
    x = F.when(k == 0, F.concat(F.lit("="), name)).when(k == 1, F.concat(F.lit("+"), name)).when(k == 2, F.concat(F.lit("-"), name)).when(k == 3, F.concat(F.lit("@"), name)).when(k == 4, F.concat(F.lit("\t"), name)).otherwise(name)
    return t.part.select("p_partkey", T.csv_safe(x).alias("safe"))


@twin(r"""
WITH s AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '3,2,1' WHEN 2 THEN '8-10' WHEN 3 THEN '' WHEN 4 THEN 'abc' WHEN 5 THEN '12000' ELSE '2.9' END AS x FROM part)
SELECT p_partkey, CASE WHEN try_cast(x AS DOUBLE) < 10000 THEN try_cast(x AS DOUBLE) END AS f, CASE WHEN regexp_matches(x, '^\d+$') AND try_cast(x AS BIGINT) BETWEEN 1 AND 40 THEN try_cast(x AS BIGINT) END AS i,
  CASE x WHEN '3,2,1' THEN 2.0 WHEN '8-10' THEN 9.0 ELSE try_cast(x AS DOUBLE) END AS reps, CASE WHEN try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE)::INT END AS strict,
  CASE WHEN x = '3,2,1' THEN '3,2,1' WHEN regexp_matches(x, '^\d+$') AND try_cast(x AS BIGINT) BETWEEN 1 AND 40 THEN x ELSE '' END AS list FROM s""")
def bounded_parse(t: Tables) -> DataFrame:
    k = F.col("p_size") % 7
    x = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "3,2,1").when(k == 2, "8-10").when(k == 3, "").when(k == 4, "abc").when(k == 5, "12000").otherwise("2.9")
    rows = t.part.select("p_partkey", x.alias("x"))
    c = F.col("x")
    return rows.select("p_partkey", N.bounded_float(c).alias("f"), N.bounded_int(c, 1, 40).alias("i"), N.representative_reps(c).alias("reps"), N.strict_int(c).alias("strict"), C.joined(C.bounded_ints(c, 1, 40)).alias("list"))
