"""Queries on writes of programmes, goals, maxima and accounts, on exports and on runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import analytics as A
from barloom.operators import exports as X
from barloom.operators import jobs as J
from barloom.operators import merge as M
from barloom.operators import programs as P
from barloom.operators import records as C
from barloom.plans import rules
from barloom.operators.store import Store
from barloom.queries.registry import Tables, twin
from barloom.session import shared_dir


@twin("""
SELECT o_custkey AS program_id, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS session_no,
  (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::INT, l_extendedprice) - 1)::INT AS exercise_no, l_partkey AS exercise_id, l_quantity::INT AS sets FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def program_tables(t: Tables) -> DataFrame:
    """Nested plans as rows of three tables; here those of exercises."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("exercise_id"), F.col("l_quantity").cast("int").alias("sets"), F.col("l_extendedprice").alias("kg"))
    own = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("exercises"))
    rows = t.orders.join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    plans = rows.groupBy(F.col("o_custkey").alias("program_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "exercises"))).alias("sessions"))
    _, _, exercises = P.program_tables(plans)
    return exercises.select("program_id", "session_no", "exercise_no", "exercise_id", "sets")


@twin("""
WITH p AS (SELECT o_orderkey AS program_id, o_custkey AS athlete_id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'draft' END AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c AS (SELECT max(program_id) AS program_id, athlete_id FROM p WHERE status = 'draft' GROUP BY athlete_id),
a AS (SELECT p.program_id, p.athlete_id, CASE WHEN c.program_id = p.program_id THEN 'active' WHEN c.program_id IS NOT NULL AND status = 'active' THEN 'superseded' ELSE status END AS status FROM p LEFT JOIN c USING (athlete_id)),
g AS (SELECT program_id FROM a WHERE status = 'superseded' AND athlete_id % 3 <> 0),
k AS (SELECT l_orderkey AS program_id, l_linenumber FROM lineitem)
SELECT a.athlete_id, count(*) FILTER (WHERE g.program_id IS NULL) AS programs, count(*) FILTER (WHERE g.program_id IS NULL AND status = 'active') AS active, count(*) FILTER (WHERE g.program_id IS NULL AND status = 'superseded') AS superseded,
  coalesce(sum(n) FILTER (WHERE g.program_id IS NULL), 0)::BIGINT AS exercises, count(*) AS logs, count(*) FILTER (WHERE g.program_id IS NULL) AS linked_logs, sum(n)::BIGINT AS entries, coalesce(sum(n) FILTER (WHERE g.program_id IS NULL), 0)::BIGINT AS linked_entries
FROM a LEFT JOIN g USING (program_id) JOIN (SELECT program_id, count(*) AS n FROM k GROUP BY 1) USING (program_id) GROUP BY a.athlete_id""")
def committed_programs(t: Tables) -> DataFrame:
    """Six tables after two commits: plans with their logs are stored, then drafts activated and superseded plans deleted."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    # rows are dealt before they are collected: lists begun beside the scan save little and spill where its tasks are large
    rows = t.lineitem.select(F.col("l_orderkey").alias("program_id"), "l_linenumber", "l_partkey", "l_quantity").repartition("program_id")
    lines = rows.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    # an order is a programme of one session, its line items are the exercises
    row = F.transform("lines", lambda x, i: F.struct(F.concat_ws("-", "program_id", i).alias("exercise_row_id"), x["l_partkey"].alias("exercise_id"), x["l_quantity"].alias("sets")))
    session = F.struct(F.col("program_id").alias("session_id"), row.alias("exercises"))
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("draft")
    plans = t.orders.join(lines, F.col("o_orderkey") == F.col("program_id")).select("program_id", F.col("o_custkey").alias("athlete_id"), status.alias("status"), F.array(session).alias("sessions"))

    def created(tx) -> None:
        made = P.create_programs(tx, plans)
        tx.append("generations", made.select("program_id", F.lit(1).alias("attempt")))
        tx.append("logs", made.select("athlete_id", F.explode("sessions.session_id").alias("session_id")))
        tx.append("entries", made.select("athlete_id", F.explode(F.flatten("sessions.exercises")).alias("e")).select("athlete_id", "e.exercise_row_id"))

    def changed(tx) -> None:
        programs = tx.read("programs")
        P.activate_programs(tx, programs.where("status = 'draft'").groupBy("athlete_id").agg(F.max("program_id").alias("program_id")))
        P.delete_programs(tx, tx.read("programs").where("status = 'superseded' AND athlete_id % 3 <> 0"), many=True)

    store.change(created)
    store.change(changed)
    count = lambda name, *more: store.read(name).groupBy("athlete_id").agg(*more)
    of = lambda s: F.count_if(F.col("status") == s)
    rows = store.read("programs").groupBy("athlete_id").agg(F.count(F.lit(1)).alias("programs"), of("active").alias("active"), of("superseded").alias("superseded"))
    planned = store.read("exercises").join(store.read("programs"), "program_id").groupBy("athlete_id").agg(F.count(F.lit(1)).alias("exercises"))
    logs = count("logs", F.count(F.lit(1)).alias("logs"), F.count("session_id").alias("linked_logs"))
    entries = count("entries", F.count(F.lit(1)).alias("entries"), F.count("exercise_row_id").alias("linked_entries"))
    return logs.join(entries, "athlete_id").join(rows, "athlete_id", "left").join(planned, "athlete_id", "left").fillna(0)


@twin("""
SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS attempt, round((event_id % 100) * 3e-6 + (event_id % 7) * 1.5e-5, 8) AS cost_usd,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN props END AS error FROM events""")
def generation_audit(t: Tables) -> DataFrame:
    rows = t.events.withColumns({"input_tokens": F.col("event_id") % 100, "output_tokens": F.col("event_id") % 7})
    out = P.audit_rows(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("props"))
    return out.select("event_id", "user_id", "attempt", F.round("cost_usd", 8).alias("cost_usd"), "status", "error")


GOALS = "g AS (SELECT o_custkey AS athlete_id, o_orderkey AS id, o_orderpriority AS goal, o_orderstatus <> 'F' AS is_active, (o_orderkey % 3)::INT AS priority, o_orderdate AS day FROM orders)"


def goals(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("athlete_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("goal"), (F.col("o_orderstatus") != "F").alias("is_active"), (F.col("o_orderkey") % 3).cast("int").alias("priority"), F.col("o_orderdate").alias("day"))


@twin(f"""
WITH {GOALS}, c AS (SELECT c_custkey AS athlete_id, c_mktsegment AS goal FROM customer WHERE c_acctbal > 5000),
k AS (SELECT athlete_id, id FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY priority DESC, id DESC) AS rn FROM g WHERE is_active) WHERE rn = 1)
SELECT g.athlete_id, g.id, CASE WHEN k.id IS NOT NULL AND c.goal IS NOT NULL THEN c.goal ELSE g.goal END AS goal, g.is_active, g.priority FROM g LEFT JOIN k ON k.id = g.id LEFT JOIN c ON c.athlete_id = g.athlete_id
UNION ALL SELECT c.athlete_id, NULL, c.goal, TRUE, 1 FROM c WHERE athlete_id NOT IN (SELECT athlete_id FROM k)""")
def goal_upsert(t: Tables) -> DataFrame:
    """The active goal of highest priority takes the change, or a new one is added."""
    changes = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("athlete_id"), F.col("c_mktsegment").alias("goal"))
    return P.goals_upserted(goals(t).drop("day"), changes)


@twin(f"""
WITH {GOALS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY priority DESC, id DESC) AS rn FROM g WHERE is_active) WHERE rn = 1),
m AS (SELECT o_custkey AS athlete_id, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS snatch, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS cj FROM orders GROUP BY 1),
r AS (SELECT k.athlete_id, goal, day, id % 4 * 100000.0031::DOUBLE AS ts, CASE WHEN id % 5 > 0 THEN 250000.0031::DOUBLE END AS tc, snatch, cj FROM k LEFT JOIN m USING (athlete_id))
SELECT athlete_id, goal, date_diff('day', DATE '1995-06-01', day::DATE)::INT AS days_to_comp, CASE WHEN snatch IS NOT NULL AND ts <> 0 THEN round_even(ts - snatch, 1) END AS snatch_gap, CASE WHEN snatch IS NOT NULL AND ts <> 0 THEN least(100, round_even(snatch / ts * 100, 0))::INT END AS snatch_pct,
  CASE WHEN cj IS NOT NULL AND tc <> 0 THEN round_even(tc - cj, 1) END AS cj_gap, CASE WHEN cj IS NOT NULL AND tc <> 0 THEN least(100, round_even(cj / tc * 100, 0))::INT END AS cj_pct FROM r""")
def goal_progress(t: Tables) -> DataFrame:
    g = goals(t).withColumns({"competition_date": F.col("day").cast("date"), "target_snatch_kg": F.col("id") % 4 * 100000.0031, "target_cj_kg": F.when(F.col("id") % 5 > 0, 250000.0031)})
    maxes = A.conditional_pivot(t.orders.withColumnRenamed("o_custkey", "athlete_id"), ["athlete_id"], "o_orderstatus", "o_totalprice", {"snatch": "F", "cj": "O"})
    return P.goal_progress(g, maxes, F.lit("1995-06-01").cast("date")).drop("goal_label", "has_targets")


@twin("""
WITH x AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT o_custkey AS athlete_id, o_orderkey AS position, coalesce(p_name, 'unknown') AS name, o_totalprice AS w FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2500),
n AS (SELECT athlete_id, x.id AS exercise_id, arg_max(w, position) AS w FROM p JOIN x USING (name) GROUP BY 1, 2), o AS (SELECT c_custkey AS athlete_id, 0::BIGINT AS exercise_id, 1.0::DOUBLE AS w FROM customer)
SELECT coalesce(o.athlete_id, n.athlete_id) AS athlete_id, coalesce(o.exercise_id, n.exercise_id) AS exercise_id, coalesce(n.w, o.w) AS weight_kg, CASE WHEN n.w IS NOT NULL THEN DATE '1995-06-01' END AS date_achieved
FROM o FULL JOIN n ON o.athlete_id = n.athlete_id AND o.exercise_id = n.exercise_id""")
def bulk_maxes(t: Tables) -> DataFrame:
    """Maxima by name: unknown names are left out, the last row of an exercise counts."""
    exercises = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    pairs = t.orders.join(t.part, F.col("p_partkey") == F.col("o_orderkey") % 2500, "left").select(F.col("o_custkey").alias("athlete_id"), F.col("o_orderkey").alias("position"), F.coalesce("p_name", F.lit("unknown")).alias("name"), F.col("o_totalprice").alias("weight_kg"))
    old = t.customer.select(F.col("c_custkey").alias("athlete_id"), F.lit(0).cast("long").alias("exercise_id"), F.lit(1.0).alias("weight_kg"), F.lit(None).cast("date").alias("date_achieved"))
    return P.maxes_by_name(old, pairs, exercises, F.lit("1995-06-01").cast("date"))


@twin("""
SELECT o_orderkey AS program_id, CASE WHEN o_orderkey % 5 = 0 THEN 'completed' WHEN o_orderkey % 7 = 0 THEN 'abandoned' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN DATE '1999-01-01' END AS end_date,
  CASE WHEN o_orderkey % 5 = 0 THEN '{"planned":' || (o_orderkey % 9) || '}' END AS outcome_summary FROM orders""")
def program_status(t: Tables) -> DataFrame:
    """Programmes that are abandoned, then those that an outcome completes."""
    rows = t.orders.select(F.col("o_orderkey").alias("program_id"), F.col("o_orderstatus").alias("status"))
    outcomes = rows.where("program_id % 5 = 0").select("program_id", F.struct((F.col("program_id") % 9).alias("planned")).alias("outcome"))
    return P.completed(P.abandoned(rows, F.col("program_id") % 7 == 0), outcomes, F.lit("1999-01-01").cast("date"))


@twin("""
WITH r AS (SELECT p_partkey AS id, p_brand AS s, p_name AS n, p_size % 13 AS priority, nullif(p_type, 'ECONOMY') AS kind FROM part), g AS (SELECT * FROM r WHERE priority BETWEEN 1 AND 10 AND kind IS NOT NULL)
SELECT id, 'added' AS what, '' AS broken FROM (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY id) AS rn FROM g) f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM r o JOIN lineitem ON l_partkey = o.id AND l_quantity > 49 WHERE o.s = f.s AND o.n = f.n)
UNION ALL SELECT id, 'refused', concat_ws(',', CASE WHEN NOT priority BETWEEN 1 AND 10 THEN 'priority' END, CASE WHEN kind IS NULL THEN 'kind' END) FROM r WHERE NOT priority BETWEEN 1 AND 10 OR kind IS NULL""")
def valid_inserts(t: Tables) -> DataFrame:
    """Bad rows are refused one by one, the others inserted unless their key is among those of parts sold in large quantities."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("s"), F.col("p_name").alias("n"), (F.col("p_size") % 13).alias("priority"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("kind"))
    old = rows.join(t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id", "left_semi")
    new, bad = P.valid_inserts(old, rows, ["s", "n"], ["id"], {"priority": F.col("priority").between(1, 10), "kind": F.col("kind").isNotNull()})
    return new.select("id", F.lit("added").alias("what"), F.lit("").alias("broken")).unionByName(bad.select("id", F.lit("refused").alias("what"), F.array_join("broken_rules", ",").alias("broken")))


@twin("""
SELECT l_orderkey AS id, l_partkey, coalesce(CASE WHEN l_linenumber > 2 THEN l_returnflag END, 'accumulation') AS phase, coalesce(CASE WHEN l_linenumber <> 4 THEN l_linenumber END, 1) AS week_number, 'Unknown' AS scheme_name, l_quantity::INT AS sets FROM lineitem WHERE l_suppkey % 4 <> 0""")
def scheme_defaults(t: Tables) -> DataFrame:
    """Percentage schemes with defaults; rows without sets are left out."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_partkey", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("phase"), F.when(F.col("l_linenumber") != 4, F.col("l_linenumber")).alias("week_number"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity").cast("int")).alias("sets"), F.lit(3).alias("reps"), F.lit(70.0).alias("intensity_pct"))
    return P.scheme_rows(rows).select("id", "l_partkey", "phase", "week_number", "scheme_name", "sets")


@twin("""
SELECT l_orderkey, l_linenumber AS day_number, l_partkey AS exercise_id, l_quantity::INT AS sets FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def scheme_lookup(t: Tables) -> DataFrame:
    """Prescriptions of a phase for the exercises of a family."""
    schemes = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("phase"), F.col("l_partkey").alias("exercise_id"), F.col("l_orderkey").alias("week_number"), F.col("l_linenumber").alias("day_number"), F.col("l_suppkey").alias("exercise_order"), F.col("l_quantity").cast("int").alias("sets"))
    exercises = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("movement_family"))
    return P.schemes_for(schemes, exercises, "A", "ECONOMY").select("l_orderkey", "day_number", "exercise_id", "sets")


@twin("""
WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS session_id, 'old' AS notes, o_orderkey AS v FROM orders), n AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS session_id, 'new' AS notes, o_orderkey + 1 AS v FROM orders)
SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(n.notes, o.notes) AS notes, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.session_id = n.session_id""")
def session_log_upsert(t: Tables) -> DataFrame:
    """An upsert on a key that is unique where it is not null: rows without one are always inserted."""
    key = lambda k: F.when(F.col("o_orderkey") % k != 0, F.col("o_orderkey")).alias("session_id")
    old = t.orders.select(key(3), F.lit("old").alias("notes"), F.col("o_orderkey").alias("v"))
    new = t.orders.select(key(4), F.lit("new").alias("notes"), (F.col("o_orderkey") + 1).alias("v"))
    return M.upsert(old, new, ["session_id"])


@twin("""
WITH m AS (SELECT l_suppkey AS athlete_id, l_partkey AS exercise_id, max(l_quantity) AS weight_kg FROM lineitem GROUP BY 1, 2)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_suppkey = m.athlete_id AND x.l_partkey = m.exercise_id)""")
def deleted_maxes(t: Tables) -> DataFrame:
    """Deletes by a key of two columns."""
    pair = [F.col("l_suppkey").alias("athlete_id"), F.col("l_partkey").alias("exercise_id")]
    return M.deleted_keys(t.lineitem.groupBy(*pair).agg(F.max("l_quantity").alias("weight_kg")), t.lineitem.where("l_returnflag = 'R'").select(*pair), ["athlete_id", "exercise_id"])


@twin("""
WITH m AS (SELECT l_suppkey AS athlete_id, l_partkey AS exercise_id, max(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), n AS (SELECT l_suppkey AS athlete_id, l_partkey AS exercise_id, max(l_quantity) AS w FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 1 GROUP BY 1, 2)
SELECT coalesce(m.athlete_id, n.athlete_id) AS athlete_id, coalesce(m.exercise_id, n.exercise_id) AS exercise_id, CASE WHEN m.w IS NULL THEN n.w WHEN n.w IS NULL THEN m.w ELSE greatest(m.w, n.w) END AS weight_kg FROM m FULL JOIN n ON m.athlete_id = n.athlete_id AND m.exercise_id = n.exercise_id""")
def promoted_maxes(t: Tables) -> DataFrame:
    """Max attempts that raise the current maximum."""
    key = [F.col("l_suppkey").alias("athlete_id"), F.col("l_partkey").alias("exercise_id")]
    maxes = t.lineitem.where("l_linestatus = 'F'").groupBy(*key).agg(F.max("l_quantity").alias("weight_kg"))
    entries = t.lineitem.select(F.col("l_suppkey").alias("athlete_id"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("exercise_id"), F.col("l_quantity").alias("weight_kg"), (F.col("l_returnflag") == "R").alias("is_max_attempt"))
    return M.promoted_maxes(maxes, entries)


@twin("""
WITH o AS (SELECT c_custkey AS id, c_acctbal AS kg, c_name AS notes FROM customer), n AS (SELECT c_custkey AS id, c_acctbal + 1 AS kg, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS notes FROM customer WHERE c_nationkey < 10)
SELECT o.id, coalesce(n.kg, o.kg) AS kg, coalesce(n.notes, o.notes) AS notes FROM o LEFT JOIN n USING (id)""")
def max_upsert(t: Tables) -> DataFrame:
    """Current maxima: the new weight counts, notes stay where none are given."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("kg"), F.col("c_name").alias("notes"))
    new = t.customer.where("c_nationkey < 10").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1).alias("kg"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("notes"))
    return M.upsert(old, new, ["id"], {"notes": M.fill})


@twin("""
WITH u AS (SELECT c_custkey AS id, c_name AS username FROM customer), c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'n' || (c_custkey // 6) WHEN 1 THEN 'Customer#000000001' ELSE c_name END AS username FROM customer WHERE c_nationkey < 12),
f AS (SELECT username, min(id) AS id FROM c GROUP BY 1), k AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.username = f.username AND u.id <> f.id))
SELECT u.id, coalesce(k.username, u.username) AS username FROM u LEFT JOIN k USING (id)""")
def renamed_users(t: Tables) -> DataFrame:
    """Names that are taken, or asked for twice, go to one account alone."""
    k = F.col("c_custkey")
    users = t.customer.select(k.alias("id"), F.col("c_name").alias("username"))
    name = F.when(k % 3 == 0, F.concat(F.lit("n"), F.floor(k / 6).cast("string"))).when(k % 3 == 1, "Customer#000000001").otherwise(F.col("c_name"))
    after, _ = P.renamed(users, t.customer.where("c_nationkey < 12").select(k.alias("id"), name.alias("username")))
    return after


@twin("""
SELECT c_custkey, nullif(CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_name END, '') AS notes, CASE WHEN c_nationkey BETWEEN 1 AND 14 THEN c_nationkey ELSE 4 END::BIGINT AS sessions_per_week, CASE WHEN abs(c_acctbal) < 10000 THEN c_acctbal END AS bodyweight_kg, CASE c_custkey % 4 WHEN 0 THEN 'UTC' ELSE c_mktsegment END AS timezone FROM customer""")
def stored_profiles(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("notes"), F.col("c_nationkey").alias("sessions_per_week"), F.col("c_acctbal").alias("bodyweight_kg"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("timezone"))
    return P.profiles(rows)


@twin("""
WITH x AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 7 END AS parent_id, 'Customer#' || lpad((c_custkey // 10)::VARCHAR, 9, '0') AS parent_name FROM customer)
SELECT x.id, coalesce(x.parent_id, p.id) AS parent_id, 1 AS flag, (SELECT min(id) FROM x WHERE name > 'Customer#000000003') AS fallback FROM x LEFT JOIN x p ON p.name = x.parent_name""")
def tree_backfill(t: Tables) -> DataFrame:
    """Parents by name where none is set, a column with a default, and an id by a scalar subquery."""
    from barloom.operators.relational import scalar_of

    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.lit(7).cast("long")).alias("parent_id"))
    names = t.customer.select(F.col("c_name").alias("name"), F.concat(F.lit("Customer#"), F.lpad(F.floor(F.col("c_custkey") / 10).cast("string"), 9, "0")).alias("parent_name"))
    out = P.with_default(P.parents_filled(rows, names), "flag", 1)
    return out.select("id", "parent_id", "flag", scalar_of(rows.where("name > 'Customer#000000003'"), F.col("id"), F.col("id")).alias("fallback"))


@twin("""
SELECT l_orderkey, l_linenumber AS week, 'a,' || l_partkey || ',b' AS session_notes, CASE WHEN l_linenumber > 3 THEN l_linenumber || ',' || (l_linenumber + 1) END AS reps, round_even(l_discount * 100, 0)::INT AS make_rate_pct, CASE WHEN l_returnflag = 'R' THEN '''=R' ELSE l_returnflag END AS exercise FROM lineitem""")
def training_log(t: Tables) -> DataFrame:
    """Columns of the training log; formulas are defused, empty lists are nothing."""
    n = F.col("l_linenumber")
    given = {"log_date": F.col("l_shipdate"), "program_name": F.lit("p"), "week_number": n, "day_number": n, "session_label": F.lit(""), "session_notes": F.concat(F.lit("a,"), F.col("l_partkey").cast("string"), F.lit(",b")), "exercise_name": F.when(F.col("l_returnflag") == "R", "=R").otherwise(F.col("l_returnflag")), "reps_per_set": F.when(n > 3, F.array(n, n + 1)).otherwise(F.array().cast("array<int>")), "make_rate": F.col("l_discount"), "technical_notes": F.lit(None).cast("string")}
    rows = t.lineitem.withColumns(given | {c: F.lit(1) for c in X.TRAINING_LOG.values() if c not in given})
    out = X.training_log(rows.withColumn("session_rpe", F.col("l_orderkey")))
    return out.select(F.col("session_rpe").alias("l_orderkey"), "week", "session_notes", "reps", "make_rate_pct", "exercise")


@twin(r"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber || ',' || l_suppkey || ',,focus,60,' || l_partkey || ',"' || 'a ""' || l_returnflag || '"", b' || '",3,5,,,' || l_quantity::INT || ',8,90,' || CASE WHEN l_linenumber % 2 = 1 THEN '1' ELSE '' END || ',,' || CASE WHEN l_returnflag = 'A' THEN 'yes' ELSE '' END || ',''=n' AS line FROM (SELECT DISTINCT * FROM lineitem)),
p AS (SELECT o_orderkey, 'program,''+' || o_orderpriority || chr(13) || chr(10) || 'phase,x' || chr(13) || chr(10) || 'status,' || o_orderstatus || chr(13) || chr(10) || 'start_date,' || strftime(o_orderdate, '%Y-%m-%d') || chr(13) || chr(10) || 'duration_weeks,4' || chr(13) || chr(10) || 'sessions_per_week,3' || chr(13) || chr(10) || chr(13) || chr(10)
  || 'week,day,session,focus_area,session_duration_min,order,exercise,sets,reps,intensity_pct,intensity_reference,weight_kg,rpe_target,rest_seconds,backoff_sets,backoff_intensity_pct,is_max_attempt,notes' || chr(13) || chr(10) AS head, trim(regexp_replace('+' || o_orderpriority, '[^\p{L}\p{N}\-_ ]', '', 'g')) || '.csv' AS file_name FROM orders),
b AS (SELECT l_orderkey, string_agg(line, chr(13) || chr(10) ORDER BY l_linenumber, split_part(line, ',', 2)::BIGINT, l_partkey, line) || chr(13) || chr(10) AS body FROM l GROUP BY 1)
SELECT o_orderkey AS program_id, file_name, sha256(head || coalesce(body, '')) AS content FROM p LEFT JOIN b ON l_orderkey = o_orderkey""")
def program_csv(t: Tables) -> DataFrame:
    """One CSV text a programme, with its metadata block and quoted fields."""
    programs = t.orders.select(F.col("o_orderkey").alias("program_id"), F.concat(F.lit("+"), "o_orderpriority").alias("name"), F.lit("x").alias("phase"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("start_date"), F.lit(4).alias("duration_weeks"), F.lit(3).alias("sessions_per_week"))
    n = F.col("l_linenumber")
    rows = t.lineitem.distinct().select(
        F.col("l_orderkey").alias("program_id"), n.alias("week_number"), F.col("l_suppkey").alias("day_number"), F.lit("").alias("session_label"), F.lit("focus").alias("focus_area"), F.lit(60).alias("session_duration_min"), F.col("l_partkey").alias("exercise_order"),
        F.concat(F.lit('a "'), "l_returnflag", F.lit('", b')).alias("exercise_name"), F.lit(3).alias("sets"), F.lit(5).alias("reps"), F.lit(None).cast("double").alias("intensity_pct"), F.lit(None).cast("string").alias("intensity_reference"), F.col("l_quantity").cast("int").alias("absolute_weight_kg"),
        F.lit(8).alias("rpe_target"), F.lit(90).alias("rest_seconds"), (n % 2).alias("backoff_sets"), F.lit(None).cast("double").alias("backoff_intensity_pct"), (F.col("l_returnflag") == "A").alias("is_max_attempt"), F.lit("=n").alias("notes"),
    )
    return X.program_files(programs, rows).withColumn("content", F.sha2("content", 256))


@twin("""
SELECT user_id AS run_id, count(*) AS chunks, count(*) FILTER (WHERE event_type = 'error') AS skipped, count(*) FILTER (WHERE value > 50) AS quarantined, sum(event_id % 9)::BIGINT AS principles FROM events GROUP BY 1""")
def run_totals(t: Tables) -> DataFrame:
    rows = t.events.withColumnRenamed("user_id", "run_id")
    return J.totals(rows, ["run_id"], {"chunks": F.lit(True), "skipped": F.col("event_type") == "error", "quarantined": F.col("value") > 50}, {"principles": F.col("event_id") % 9})


@twin("""
WITH RECURSIVE r AS (SELECT user_id, event_id, ts, least(ts + INTERVAL 1 SECOND * (event_id % 40 * 30), ts + INTERVAL 660 SECOND) AS until FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM r),
w AS (SELECT user_id, event_id, ts, i, until, true AS admitted FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.i, CASE WHEN o.ts >= w.until THEN o.until ELSE w.until END, o.ts >= w.until FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id AS athlete_id, event_id AS request_id, admitted FROM w""")
def job_admission(t: Tables) -> DataFrame:
    """One request an athlete is in flight at a time, for eleven minutes at most."""
    rows = t.events.select(F.col("user_id").alias("athlete_id"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"), (F.col("ts") + F.make_interval(secs=(F.col("event_id") % 40 * 30).cast("double"))).alias("finished_at"))
    return J.admitted(rows).select("athlete_id", "request_id", "admitted")


@twin("""
WITH h AS (SELECT url, regexp_extract(lower(url), '^https?://([^/:?#]*)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1, 2)
SELECT host, url, ((row_number() OVER (PARTITION BY host ORDER BY page_id, url) - 1) // 10)::INT AS flush_no FROM h""")
def progress_flushes(t: Tables) -> DataFrame:
    """Finished URLs of each host, and the flush that writes each."""
    from barloom.sources.web import same_host

    rows = t.pages.select("page_id", "url", same_host(F.col("url")).alias("host"))
    return J.flushes(rows, ["host"], ["page_id"]).select("host", "url", "flush_no")


@twin("""
SELECT regexp_extract(lower(url), '^https?://([^/:?#]*)', 1) AS host, '["' || string_agg(DISTINCT url, '","' ORDER BY url) || '"]' AS progress FROM pages GROUP BY 1""")
def progress_sets(t: Tables) -> DataFrame:
    from barloom.sources.web import same_host

    return J.progress_json(t.pages.select(same_host(F.col("url")).alias("host"), "url"), ["host"])


@twin("""
WITH r AS (SELECT event_id AS run_id, user_id AS file_hash, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, (event_id % 57)::INT AS processed, ts FROM events WHERE user_id % 2 = 1 OR event_type <> 'purchase'),
l AS (SELECT file_hash, arg_max(status, (ts, run_id)) AS status, arg_max(processed, (ts, run_id)) AS processed, bool_or(status = 'completed') AS done FROM r GROUP BY 1)
SELECT doc_id, coalesce(f.at, 0) AS resumed_from FROM documents LEFT JOIN (SELECT file_hash, (processed // 10 * 10)::INT AS at FROM l WHERE NOT done AND status = 'failed') f ON f.file_hash = doc_id % 300 WHERE doc_id % 60 >= coalesce(f.at, 0)""")
def resumed_sections(t: Tables) -> DataFrame:
    """Sections that are left of files whose latest run failed."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    runs = t.events.where("user_id % 2 = 1 OR event_type <> 'purchase'").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("file_hash"), kind.alias("status"), (F.col("event_id") % 57).alias("processed"), "ts")
    sections = t.documents.select("doc_id", (F.col("doc_id") % 300).alias("file_hash"), (F.col("doc_id") % 60).alias("position"))
    points = J.resume_points(runs)
    left = J.remaining_sections(sections, points)
    at = points.withColumnRenamed("file_hash", "h")
    return left.join(at, F.col("file_hash") == F.col("h"), "left").select("doc_id", F.coalesce("resume_from", F.lit(0)).alias("resumed_from"))


@twin("""
SELECT p_name AS exercise_name, round(avg(l_quantity / 5.0 - (6 + l_tax * 10)), 6) AS avg_overshoot, count(*) AS sessions FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 2 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1 HAVING avg(l_quantity / 5.0 - (6 + l_tax * 10)) > -1.3""")
def effort_overshoot(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.col("p_name").alias("exercise_name"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 5.0).alias("rpe"), (6 + F.col("l_tax") * 10).alias("rpe_target"))
    return A.overshoot(rows, ["exercise_name"], least=-1.3).withColumn("avg_overshoot", F.round("avg_overshoot", 6))


@twin("""
SELECT p_name AS exercise_name, l_linenumber AS week_number, round(avg(l_discount), 6) AS avg_make_rate FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') GROUP BY 1, 2""")
def make_rates_by_week(t: Tables) -> DataFrame:
    entries = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_name").alias("exercise_name"), F.col("l_partkey").alias("exercise_id"), F.col("l_linenumber").alias("week_number"), F.col("l_discount").alias("make_rate"))
    return A.make_rates_by_week(entries, t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category")), "ECONOMY").withColumn("avg_make_rate", F.round("avg_make_rate", 6))


@twin("""
SELECT l_orderkey, p_name AS lift, round_even(avg(CASE WHEN l_linenumber > 1 THEN l_discount * 7.123457::DOUBLE END), 2) AS make_rate FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber > 1 GROUP BY 1, 2""")
def success_by_lift(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", F.col("p_name").alias("lift"), F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 7.123457).alias("make_rate"))
    return A.success_by_lift(rows, ["l_orderkey"])


@twin("""
SELECT user_id, max(CASE WHEN event_type = 'error' THEN props END) AS largest_text, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 50""")
def largest_error(t: Tables) -> DataFrame:
    """The users with most errors, with the largest error text by character order."""
    return A.last_text(t.events, ["user_id"], F.col("props"), F.col("event_type") == "error", 50)


VERDICT = f"""
v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'general_prep' WHEN 2 THEN 'accumulation' WHEN 3 THEN 'intensification' WHEN 4 THEN 'realization' ELSE 'unheard' END AS p, (o_orderkey % 101)::DOUBLE AS a, (o_orderkey % 41) / 40.0::DOUBLE AS m, (o_orderkey % 29) / 10.0::DOUBLE AS e FROM orders),
s AS (SELECT *, CASE WHEN p IS NULL OR p = 'unheard' THEN 'cold_start' WHEN p = 'realization' THEN 'realization_rebuild' WHEN a >= {rules.MIN_ADHERENCE} AND m >= {rules.MIN_SUCCESS} AND NOT e > {rules.MAX_EFFORT} THEN 'advanced' WHEN a >= {rules.MIN_ADHERENCE} AND m >= {rules.MIN_SUCCESS} THEN 'rpe_held' ELSE 'repeated' END AS status FROM v)"""


@twin(f"""
WITH {VERDICT}
SELECT o_orderkey, status, CASE status WHEN 'cold_start' THEN 'No previous phase — starting at Accumulation' WHEN 'realization_rebuild' THEN 'Realization complete — rebuilding with Accumulation' WHEN 'advanced' THEN 'All thresholds met — phase advanced'
  WHEN 'rpe_held' THEN printf('RPE deviation too high (%+.2f) — phase held despite good adherence and make rate', e)
  ELSE 'Phase repeated — ' || concat_ws(', ', CASE WHEN a < {rules.MIN_ADHERENCE} THEN 'Adherence' END, CASE WHEN m < {rules.MIN_SUCCESS} THEN 'Make rate' END, CASE WHEN e > {rules.MAX_EFFORT} THEN 'RPE deviation' END) || ' below threshold' END AS reason,
  CASE p WHEN 'general_prep' THEN 'General Prep' WHEN 'accumulation' THEN 'Accumulation' WHEN 'intensification' THEN 'Intensification' WHEN 'realization' THEN 'Realization' ELSE coalesce(p, '—') END AS prev_label FROM s""")
def verdict_reasons(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ["general_prep", "accumulation", "intensification", "realization", "unheard"])), (k % 6 + 1).cast("int"))
    rows = t.orders.select(k, p.alias("p"), (k % 101).cast("double").alias("a"), ((k % 41) / 40.0).alias("m"), ((k % 29) / 10.0).alias("e"))
    rows = rows.withColumn("v", rules.verdict(F.col("p"), F.col("a"), F.col("m"), F.col("e")))
    return rows.select(k, F.col("v.next.status").alias("status"), rules.verdict_reason(F.col("v.next"), F.col("v.failing"), F.col("e")).alias("reason"), rules.phase_label(F.col("p")).alias("prev_label"))


@twin("""
SELECT l_orderkey AS run_id, l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' AND false
UNION ALL SELECT -1, p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A')""")
def rolled_back(t: Tables) -> DataFrame:
    """Chunks that another run still refers to after one is taken back."""
    log = t.lineitem.select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("chunk_id"))
    _, left = M.rolled_back(t.part.select(F.col("p_partkey").alias("id")), log, F.col("run") == "A")
    return left.select(F.lit(-1).cast("long").alias("run_id"), "id")


@twin("""
SELECT p_partkey AS id, substr(p_name, 1, 300) AS name, CASE p_size % 4 WHEN 0 THEN 'competition_prep' WHEN 1 THEN 'general_strength' WHEN 2 THEN 'technique_focus' ELSE 'other' END AS goal, CASE p_size % 3 WHEN 0 THEN 'beginner' ELSE 'any' END AS athlete_level, (p_size % 5)::INT AS duration_weeks, 3 AS sessions_per_week, md5('{"a":' || p_size || '}') AS structure_md5
FROM part WHERE p_size % 5 >= 1""")
def template_rows(t: Tables) -> DataFrame:
    """Programme templates: goal words mapped, unknown levels any, impossible dimensions refused."""
    k = F.col("p_size")
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(k % 4 == 0, " Peaking ").when(k % 4 == 1, "strength").when(k % 4 == 2, "Technique").otherwise("other").alias("goal"), F.when(k % 3 == 0, "Beginner").otherwise("expert").alias("athlete_level"), (k % 5).cast("string").alias("duration_weeks"), F.lit("3").alias("sessions_per_week"), F.concat(F.lit('{ "a": '), k.cast("string"), F.lit("}")).alias("structure"))
    return C.program_templates(rows).select("id", "name", "goal", "athlete_level", "duration_weeks", "sessions_per_week", "structure_md5")


@twin("SELECT o_custkey, (max(o_orderkey) + 1) AS test_day FROM orders GROUP BY 1")
def test_days(t: Tables) -> DataFrame:
    return C.test_day(t.orders, ["o_custkey"], "o_orderkey")


@twin("SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_mktsegment END, ''), 'none') AS segment, CASE WHEN c_nationkey = 0 THEN 99 ELSE c_nationkey END AS nation FROM customer")
def defaulted_rows(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    return C.defaulted(rows, segment="none", nation=99)
