"""Queries on incoming records, budgets and keyed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import records as R
from barloom.queries.registry import Tables, twin


@twin("""
SELECT c_custkey, concat_ws(',', CASE WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), false) THEN 'segment' END, CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'balance' END) AS broken FROM customer
WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), false) OR NOT coalesce(c_acctbal >= 0, false)""")
def rejected_profiles(t: Tables) -> DataFrame:
    """Rows that break a rule, with the rules."""
    _, bad = R.checked(t.customer, {"segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "balance": F.col("c_acctbal") >= 0})
    return bad.select("c_custkey", F.array_join("broken_rules", ",").alias("broken"))


@twin("""
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 3 <> 0 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey = o.o_orderkey + 1) THEN o.o_orderkey + 1 END AS session_id FROM orders o""")
def validated_links(t: Tables) -> DataFrame:
    """A link counts if it is a number that was offered to that athlete."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, "x1").otherwise((F.col("o_orderkey") + 1).cast("string"))
    rows = t.orders.select("o_orderkey", "o_custkey", raw.alias("raw"))
    offered = t.orders.select("o_custkey", F.col("o_orderkey").alias("session_id"))
    return R.linked(rows, "raw", offered, ["o_custkey"], "session_id").select("o_orderkey", "session_id")


@twin("""
SELECT o_custkey, o_orderkey, round(spent, 2) AS spent_before FROM (SELECT o_custkey, o_orderkey, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders) WHERE spent < 600000.005""")
def cost_limit(t: Tables) -> DataFrame:
    out = R.within_budget(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 600000.005)
    return out.select("o_custkey", "o_orderkey", F.round("spent_before", 2).alias("spent_before"))


@twin("SELECT user_id, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, round(sum((event_id % 100) * 3e-6 + (event_id % 7) * 1.5e-5), 8) AS cost FROM events GROUP BY 1")
def token_totals(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    return R.token_totals(rows, "user_id").withColumn("cost", F.round("cost", 8))


@twin("SELECT p_size, replace(replace(lower(p_name), ' ', '_'), '&', 'and') AS lift, arg_max(p_retailprice, p_partkey) AS weight_kg FROM part GROUP BY 1, 2")
def keyed_maxima(t: Tables) -> DataFrame:
    rows = t.part.select("p_size", F.col("p_name").alias("exercise_name"), F.col("p_retailprice").alias("weight_kg"), F.col("p_partkey").alias("id"))
    return R.keyed_maxima(rows, ["p_size"])


@twin("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS done, o_totalprice, min(o_orderkey) OVER (PARTITION BY o_custkey) = o_orderkey AS first FROM orders)
SELECT o_custkey, count(*) AS sessions, count(*) FILTER (WHERE done) AS done, min(o_totalprice) FILTER (WHERE first) AS low, max(o_totalprice) FILTER (WHERE first) AS high, round_even(count(*) FILTER (WHERE done) * 100.0::DOUBLE / count(*), 0)::INT AS done_pct FROM r GROUP BY 1""")
def session_summary(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("session_id"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").alias("intensity_pct"))
    return R.session_summary(rows, ["o_custkey"])


@twin("""
WITH p AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS kg FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), e AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT e.l_orderkey AS session_id, e.l_partkey AS entry, p.l_partkey AS planned_id, CASE WHEN q <> 0 AND kg <> 0 THEN round_even(q - kg, 2) END AS weight_deviation_kg FROM e LEFT JOIN p ON p.l_orderkey = e.l_orderkey AND p.l_partkey = e.l_partkey""")
def entry_deviations(t: Tables) -> DataFrame:
    """Deviations from the plan; links to rows of another session are dropped."""
    planned = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("planned_id"), F.col("l_orderkey").alias("session_id")).agg(F.max("l_extendedprice").alias("planned_kg")).withColumn("rpe_target", F.lit(8.0))
    entries = t.lineitem.groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("planned_id")).agg(F.max("l_quantity").alias("weight_kg")).withColumns({"entry": F.col("planned_id"), "rpe": F.lit(None).cast("double"), "log_id": F.lit(1)})
    return R.logged_entries(entries, planned).select("session_id", "entry", "planned_id", "weight_deviation_kg")


@twin("""
WITH f AS (SELECT user_id AS id, event_id, ts::DATE AS day, value, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN NULL ELSE 20000 END AS rpe, (event_id % 40 - 5)::INT AS minutes, (event_id % 8)::INT AS sleep, (event_id % 7)::INT AS stress, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS notes FROM events),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1)
SELECT c_custkey AS id, c_name AS title, CASE WHEN l.id IS NULL THEN DATE '2023-01-01' WHEN day <= DATE '2024-01-25' THEN day ELSE DATE '2024-01-25' END AS log_date, CASE WHEN l.id IS NULL THEN 7.5 WHEN rpe < 10000 THEN rpe END AS overall_rpe, CASE WHEN l.id IS NULL THEN 60 WHEN minutes >= 1 THEN minutes END AS session_duration_minutes,
  CASE WHEN l.id IS NULL THEN 80.0 ELSE value END::DOUBLE AS bodyweight_kg, CASE WHEN l.id IS NULL THEN 3 WHEN sleep BETWEEN 1 AND 5 THEN sleep END AS sleep_quality, CASE WHEN l.id IS NULL THEN 2 WHEN stress BETWEEN 1 AND 5 THEN stress END AS stress_level, CASE WHEN l.id IS NULL THEN 'as before' ELSE notes END AS athlete_notes
FROM customer LEFT JOIN l ON l.id = c_custkey""")
def updated_logs(t: Tables) -> DataFrame:
    """Logs of customers after the forms that events stand for; the last form of a log is stored, whole."""
    logs = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("2023-01-01").cast("date").alias("log_date"), F.lit(7.5).alias("overall_rpe"), F.lit(60).alias("session_duration_minutes"), F.lit(80.0).alias("bodyweight_kg"),
        F.lit(3).alias("sleep_quality"), F.lit(2).alias("stress_level"), F.lit("as before").alias("athlete_notes"),
    )
    k, text = F.col("event_id"), lambda c: c.cast("string")
    forms = t.events.select(
        F.col("user_id").alias("log_id"), k.alias("position"), F.date_format("ts", "yyyy-MM-dd").alias("log_date"), F.when(k % 4 == 0, text(F.col("value"))).when(k % 4 == 1, "much").otherwise("20000").alias("overall_rpe"), text(k % 40 - 5).alias("duration"),
        text(F.col("value")).alias("bodyweight"), text(k % 8).alias("sleep_quality"), text(k % 7).alias("stress_level"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("notes"),
    )
    return R.updated_logs(logs, forms, F.lit("2024-01-25").cast("date"))


@twin("""
WITH e AS (SELECT o_orderkey AS id, o_custkey AS log_id, o_orderkey % 40 AS planned_id, (o_orderkey % 90)::DOUBLE AS prescribed FROM orders),
f AS (SELECT l_orderkey AS id, o_custkey AS log_id, l_extendedprice AS position, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS w, (l_suppkey % 10)::DOUBLE AS rpe, l_quantity AS mr, CASE l_linenumber WHEN 1 THEN '3,2,1' WHEN 2 THEN '5,5' END AS reps, CASE WHEN l_linenumber % 2 = 0 THEN 4 END AS sets, l_returnflag AS notes FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 7),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id, log_id ORDER BY position DESC) = 1), p AS (SELECT n_nationkey AS planned_id, 6.0 + n_nationkey % 4 AS target FROM nation)
SELECT e.id, e.log_id, CASE WHEN l.id IS NULL THEN 1.0 ELSE coalesce(w, 0) END::DOUBLE AS weight_kg, l.rpe, l.mr / 100 AS make_rate, coalesce(CASE WHEN l.id IS NOT NULL THEN reps END, '') AS reps, CASE WHEN l.id IS NULL THEN 9 ELSE coalesce(sets, len(string_split(reps, ',')), 1) END::INT AS sets_completed, l.notes AS technical_notes,
  CASE WHEN w <> 0 AND prescribed <> 0 THEN round_even(w - prescribed, 2) END AS weight_deviation_kg, CASE WHEN l.rpe <> 0 AND target <> 0 THEN round_even(l.rpe - target::DOUBLE, 1) END AS rpe_deviation
FROM e LEFT JOIN l ON l.id = e.id AND l.log_id = e.log_id LEFT JOIN p ON p.planned_id = e.planned_id""")
def updated_entries(t: Tables) -> DataFrame:
    """Entries after forms of some, with their deviations anew; forms that name another log change nothing."""
    k, none = F.col("o_orderkey"), F.lit(None)
    entries = t.orders.select(
        k.alias("id"), F.col("o_custkey").alias("log_id"), (k % 40).alias("planned_id"), (k % 90).cast("double").alias("prescribed_weight_kg"), F.lit(1.0).alias("weight_kg"), none.cast("double").alias("rpe"), none.cast("double").alias("make_rate"), none.cast("array<int>").alias("reps_per_set"),
        F.lit(9).alias("sets_completed"), none.cast("string").alias("technical_notes"), none.cast("double").alias("weight_deviation_kg"), none.cast("double").alias("rpe_deviation"),
    )
    line, text = F.col("l_linenumber"), lambda c: c.cast("string")
    forms = t.lineitem.join(t.orders, F.col("l_orderkey") == k).select(
        k.alias("id"), F.when(line == 7, -1).otherwise(F.col("o_custkey")).alias("log_id"), F.col("l_extendedprice").alias("position"), F.when(line % 3 > 0, text(F.col("l_quantity"))).otherwise("").alias("weight_kg"), text(F.col("l_suppkey") % 10).alias("rpe"), text(F.col("l_quantity")).alias("make_rate"),
        F.when(line == 1, "3,2,1").when(line == 2, "5,, 5").when(line == 3, "0,2").when(line == 4, "x").otherwise("").alias("reps_per_set"), F.when(line % 2 == 0, "4").otherwise("").alias("sets_completed"), F.col("l_returnflag").alias("technical_notes"),
    )
    planned = t.nation.select(F.col("n_nationkey").alias("planned_id"), (6.0 + F.col("n_nationkey") % 4).alias("rpe_target"))
    out = R.updated_entries(entries, forms, planned)
    return out.select("id", "log_id", "weight_kg", "rpe", "make_rate", F.coalesce(F.array_join("reps_per_set", ","), F.lit("")).alias("reps"), "sets_completed", "technical_notes", "weight_deviation_kg", "rpe_deviation")
