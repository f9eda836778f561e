"""Planning and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import relational as R
from barloom.plans import rules as P
from barloom.plans import validation as V
from barloom.queries.registry import Tables, twin

WEEK_ROWS = ", ".join(f"('{w[0]}', {w[1]}, {w[2]}, {w[3]}, {w[4]}, {w[5]}, {w[6]}, {str(w[7]).lower()})" for w in P.WEEKS)
LEVEL_ROWS = ", ".join(f"('{x[0]}', {x[1]}, {x[2]})" for x in P.LEVELS)
DAY_ROWS = ", ".join(f"({a}, {b}, {c})" for a, b, c in P.DAYS)
ZONE_CASE = "CASE WHEN {x} >= 90 THEN 7 WHEN {x} >= 80 THEN 15 WHEN {x} >= 70 THEN 18 WHEN {x} >= 65 THEN 20 ELSE 24 END"
ZONE_NAME = "CASE WHEN {x} >= 90 THEN '90-100' WHEN {x} >= 80 THEN '80-90' WHEN {x} >= 70 THEN '70-80' WHEN {x} >= 65 THEN '65-70' WHEN {x} >= 55 THEN '55-65' END"
TARGETS = f"""
w(phase, week, fl, ce, vol, rl, rh, deload) AS (VALUES {WEEK_ROWS}), lv(level, off, scale) AS (VALUES {LEVEL_ROWS}),
prof AS (SELECT phase, count(*) AS have, count(*) FILTER (WHERE NOT deload) AS n, count(*) FILTER (WHERE deload) AS nd FROM w GROUP BY 1),
wk AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY week) AS i FROM w WHERE NOT deload),
plan AS (SELECT p.phase, d::INT AS duration, level, have, n, nd FROM prof p, unnest(range(1, 9)) AS u(d), lv),
cell AS (SELECT plan.*, k::INT AS week_number, CASE WHEN duration <= have THEN have - duration + k END AS src,
  CASE WHEN duration > have AND k <= duration - nd THEN CASE WHEN k <= n THEN k ELSE n // 2 + (k - n - 1) % (n - n // 2) + 1 END END AS wi FROM plan, unnest(range(1, duration + 1)) AS u(k)),
t AS (SELECT c.phase, c.duration, c.level, c.week_number, coalesce(a.fl, b.fl, x.fl)::DOUBLE AS fl, coalesce(a.ce, b.ce, x.ce)::DOUBLE AS ce, coalesce(a.vol, b.vol, x.vol)::DOUBLE AS vol, coalesce(a.rl, b.rl, x.rl) AS rl, coalesce(a.rh, b.rh, x.rh) AS rh, nd > 0 AND c.week_number = c.duration AS is_deload
  FROM cell c LEFT JOIN w a ON a.phase = c.phase AND a.week = c.src LEFT JOIN wk b ON b.phase = c.phase AND b.i = c.wi LEFT JOIN w x ON x.phase = c.phase AND x.deload AND c.src IS NULL AND c.wi IS NULL),
tt AS (SELECT phase, duration, level, week_number, fl + off AS intensity_floor, least(ce + off, 100.0)::DOUBLE AS intensity_ceiling, vol * scale::DOUBLE AS volume_modifier, rl AS reps_low, rh AS reps_high, is_deload FROM t JOIN lv USING (level))"""


def all_plans(t: Tables) -> DataFrame:
    phases = t.spark.createDataFrame([(p,) for p in P.PHASES], "phase string")
    return phases.join(t.spark.range(1, 9).select(F.col("id").cast("int").alias("duration"))).join(P.levels(t.spark).select("level"))


@twin(f"WITH {TARGETS} SELECT phase, duration, level, week_number, intensity_floor, intensity_ceiling, round(volume_modifier, 6) AS volume_modifier, reps_low, reps_high, is_deload FROM tt")
def weekly_targets(t: Tables) -> DataFrame:
    """Targets for every phase, length and level."""
    return P.weekly_targets(all_plans(t)).withColumn("volume_modifier", F.round("volume_modifier", 6))


@twin(f"""
WITH {TARGETS}, d(sessions, day, share) AS (VALUES {DAY_ROWS}), f AS (SELECT tt.*, s::INT AS want, CASE WHEN s <= 3 THEN 3 WHEN s = 4 THEN 4 ELSE 5 END AS sessions FROM tt, unnest(range(2, 7)) AS u(s))
SELECT phase, duration, level, want, week_number, sum(greatest(3, round_even({ZONE_CASE.format(x="((intensity_floor + intensity_ceiling) / 2)")} * share::DOUBLE * volume_modifier, 0)))::BIGINT AS total_reps FROM f JOIN d USING (sessions) GROUP BY ALL""")
def week_totals(t: Tables) -> DataFrame:
    """Reps of a week over the sessions of the nearest supported frequency."""
    want = t.spark.range(2, 7).select(F.col("id").cast("int").alias("want"))
    return P.week_totals(P.weekly_targets(all_plans(t)).join(want), "want").select("phase", "duration", "level", "want", "week_number", "total_reps")


@twin(f"""
WITH {TARGETS} SELECT phase, duration, level, week_number, CASE WHEN is_deload THEN round(volume_modifier, 6) ELSE round_even(greatest(0.4, volume_modifier - 0.15), 2) END AS volume_modifier,
  CASE WHEN is_deload THEN intensity_ceiling ELSE round_even(greatest(intensity_floor, least(100.0, intensity_ceiling - 3)), 1) END AS intensity_ceiling, least(intensity_floor, CASE level WHEN 'beginner' THEN 75.0 ELSE 80.0 END)::DOUBLE AS cold_floor,
  max(CASE WHEN NOT is_deload THEN week_number END) OVER (PARTITION BY phase, duration, level) AS peak_week FROM tt""")
def adjusted_targets(t: Tables) -> DataFrame:
    """Targets after a poor outcome, the cold-start floor, and the peak week."""
    base = P.weekly_targets(all_plans(t))
    volume, ceiling = P.load_deltas(F.lit(60.0), F.lit(0.7), F.lit(1.2))
    keys = ["phase", "duration", "level"]
    out = P.adjusted_targets(base, volume, ceiling).join(P.peak_week(base, keys), keys)
    cold = P.cold_start(base).select(*keys, "week_number", F.col("intensity_floor").alias("cold_floor"))
    return out.join(cold, [*keys, "week_number"]).select(*keys, "week_number", F.round("volume_modifier", 6).alias("volume_modifier"), "intensity_ceiling", "cold_floor", "peak_week")


METRICS = """
m AS (SELECT o_custkey, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'general_prep' WHEN 2 THEN 'accumulation' WHEN 3 THEN 'intensification' ELSE 'realization' END AS previous, count(*) FILTER (WHERE o_orderstatus <> 'P') * 100.0::DOUBLE / count(*) AS adherence,
  count(*) FILTER (WHERE o_orderpriority <> '5-LOW') * 1.0::DOUBLE / count(*) AS success, count(*) FILTER (WHERE o_orderstatus = 'O') * 4.0::DOUBLE / count(*) AS effort, CASE WHEN o_custkey % 7 < 3 THEN (o_custkey % 12)::INT END AS weeks_out FROM orders GROUP BY 1, 2)"""


@twin(f"""
WITH {METRICS}, d AS (SELECT *, adherence >= 70 AND success >= 0.75 AS ready, effort > 1.5 AS blocked FROM m),
n AS (SELECT *, CASE WHEN previous IS NULL OR previous = 'realization' THEN 'accumulation' WHEN ready AND NOT blocked THEN CASE previous WHEN 'general_prep' THEN 'accumulation' WHEN 'accumulation' THEN 'intensification' ELSE 'realization' END ELSE previous END AS phase,
  CASE WHEN previous IS NULL THEN 'cold_start' WHEN previous = 'realization' THEN 'realization_rebuild' WHEN ready AND NOT blocked THEN 'advanced' WHEN ready THEN 'rpe_held' ELSE 'repeated' END AS status FROM d)
SELECT o_custkey, phase, status = 'advanced' AS advanced, status, concat_ws(',', CASE WHEN adherence < 70 THEN 'adherence' END, CASE WHEN success < 0.75 THEN 'make_rate' END, CASE WHEN blocked THEN 'rpe_deviation' END) AS failing,
  concat_ws(',', CASE WHEN adherence < 70 THEN 'volume_minus_10' END, CASE WHEN success < 0.75 THEN 'ceiling_minus_3' END, CASE WHEN effort > 1 THEN 'volume_minus_5' END, CASE WHEN adherence >= 90 AND success >= 0.85 THEN 'ceiling_plus_2' END) AS adjustments,
  CASE WHEN weeks_out >= 8 THEN 'accumulation' WHEN weeks_out >= 4 THEN 'intensification' WHEN weeks_out IS NOT NULL THEN 'realization' WHEN previous IS NOT NULL THEN phase ELSE 'general_prep' END AS plan_phase,
  CASE WHEN weeks_out >= 4 THEN 4 WHEN weeks_out IS NOT NULL THEN least(3, greatest(1, weeks_out)) WHEN previous IS NOT NULL THEN CASE phase WHEN 'general_prep' THEN 5 WHEN 'realization' THEN 3 ELSE 4 END ELSE 5 END AS plan_weeks FROM n""")
def phase_decision(t: Tables) -> DataFrame:
    """Next phase, verdict, load changes and the plan's phase and length, for every athlete."""
    k = F.col("o_custkey") % 5
    previous = F.when(k == 1, "general_prep").when(k == 2, "accumulation").when(k == 3, "intensification").when(k == 4, "realization")
    n = F.count(F.lit(1))
    m = t.orders.groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") != "P") * 100.0 / n).alias("adherence"), (F.count_if(F.col("o_orderpriority") != "5-LOW") * 1.0 / n).alias("success"), (F.count_if(F.col("o_orderstatus") == "O") * 4.0 / n).alias("effort"))
    m = m.withColumns({"previous": previous, "weeks_out": F.when(F.col("o_custkey") % 7 < 3, (F.col("o_custkey") % 12).cast("int"))})
    out = m.withColumn("v", P.verdict(F.col("previous"), F.col("adherence"), F.col("success"), F.col("effort")))
    out = out.withColumn("plan", P.phase_and_weeks(F.col("weeks_out"), F.col("previous"), F.col("v.next.phase"), F.lit("work_capacity")))
    return out.select("o_custkey", F.col("v.next.phase").alias("phase"), F.col("v.next.advanced").alias("advanced"), F.col("v.next.status").alias("status"), F.array_join("v.failing", ",").alias("failing"), F.array_join("v.adjustments", ",").alias("adjustments"), F.col("plan.phase").alias("plan_phase"), F.col("plan.weeks").alias("plan_weeks"))


GOAL_ROWS = ", ".join(f"({i}, '{g}', '{p}', {w})" for i, (g, (p, w)) in enumerate(P.GOALS.items()))
LEVEL_NAMES = ", ".join(f"({i}, '{x[0]}')" for i, x in enumerate(P.LEVELS))


@twin(f"""
WITH {TARGETS}, {METRICS}, goals(k, goal, gphase, gweeks) AS (VALUES {GOAL_ROWS}), names(k, level) AS (VALUES {LEVEL_NAMES}), d(sessions, day, share) AS (VALUES {DAY_ROWS}),
a AS (SELECT c_custkey AS athlete_id, names.level, (c_custkey % 7 + 1)::INT AS per_week, gphase, gweeks, m.previous, adherence, success, effort, CASE WHEN c_custkey % 7 < 3 THEN (c_custkey % 12)::INT END AS wo FROM customer JOIN goals ON goals.k = c_custkey % 6 JOIN names ON names.k = c_nationkey % 4 LEFT JOIN m ON o_custkey = c_custkey),
n AS (SELECT *, CASE WHEN previous = 'realization' THEN 'accumulation' WHEN adherence >= 70 AND success >= 0.75 AND NOT effort > 1.5 THEN CASE previous WHEN 'general_prep' THEN 'accumulation' WHEN 'accumulation' THEN 'intensification' ELSE 'realization' END ELSE previous END AS nextp FROM a),
c AS (SELECT *, CASE WHEN wo >= 8 THEN 'accumulation' WHEN wo >= 4 THEN 'intensification' WHEN wo IS NOT NULL THEN 'realization' WHEN previous IS NOT NULL THEN nextp ELSE gphase END AS phase,
  CASE WHEN wo >= 4 THEN 4 WHEN wo IS NOT NULL THEN least(3, greatest(1, wo)) WHEN previous IS NOT NULL THEN CASE nextp WHEN 'general_prep' THEN 5 WHEN 'realization' THEN 3 ELSE 4 END ELSE gweeks END AS weeks FROM n),
r AS (SELECT c.athlete_id, c.level, c.per_week, c.previous, tt.phase, tt.duration, week_number, reps_low, reps_high, is_deload, intensity_floor AS fl, intensity_ceiling AS ce, volume_modifier AS vm, CASE c.level WHEN 'beginner' THEN 75.0 ELSE 80.0 END::DOUBLE AS cap,
    CASE WHEN previous IS NULL THEN 0 ELSE CASE WHEN adherence < 70 THEN -0.10::DOUBLE ELSE 0 END + CASE WHEN effort > 1 THEN -0.05::DOUBLE ELSE 0 END END AS dv, CASE WHEN previous IS NULL THEN 0 ELSE CASE WHEN success < 0.75 THEN -3.0::DOUBLE ELSE 0 END + CASE WHEN adherence >= 90 AND success >= 0.85 THEN 2.0::DOUBLE ELSE 0 END END AS dc
  FROM c JOIN tt ON tt.phase = c.phase AND tt.level = c.level AND tt.duration = CASE WHEN previous IS NULL THEN least(4, weeks) ELSE weeks END),
k AS (SELECT *, CASE WHEN previous IS NULL THEN least(fl, cap) ELSE fl END AS f2, CASE WHEN previous IS NULL THEN least(ce, cap) WHEN NOT is_deload AND (dv <> 0 OR dc <> 0) THEN round_even(greatest(fl, least(100.0, ce + dc)), 1) ELSE ce END AS c2, CASE WHEN previous IS NOT NULL AND NOT is_deload AND (dv <> 0 OR dc <> 0) THEN round_even(greatest(0.4, vm + dv), 2) ELSE vm END AS v2 FROM r),
s AS (SELECT k.*, CASE WHEN per_week <= 3 THEN 3 WHEN per_week = 4 THEN 4 ELSE 5 END AS sessions FROM k)
SELECT *, max(CASE WHEN NOT is_deload THEN week_number END) OVER (PARTITION BY athlete_id) AS peak_week FROM (
  SELECT athlete_id, phase, duration, CASE WHEN previous IS NOT NULL THEN 5 WHEN level = 'beginner' THEN 2 ELSE 3 END AS max_complexity, week_number, f2 AS intensity_floor, c2 AS intensity_ceiling, round(v2, 6) AS volume_modifier, reps_low, reps_high, is_deload,
    sum(greatest(3, round_even({ZONE_CASE.format(x="((f2 + c2) / 2)")} * share::DOUBLE * v2, 0)))::BIGINT AS total_reps
  FROM s JOIN d USING (sessions) GROUP BY ALL)""")
def athlete_plans(t: Tables) -> DataFrame:
    """The next programme of every customer, week by week, from the outcome of their orders: phase, length, targets, first-programme caps, peak week."""
    from barloom import engine

    k, n = F.col("c_custkey"), F.count(F.lit(1))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    made = t.orders.groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") != "P") * 100.0 / n).alias("adherence_pct"), (F.count_if(F.col("o_orderpriority") != "5-LOW") * 1.0 / n).alias("make_rate"), (F.count_if(F.col("o_orderstatus") == "O") * 4.0 / n).alias("rpe_deviation"))
    made = made.withColumn("previous_phase", pick(P.PHASES, F.col("o_custkey") % 5 - 1))
    today = F.lit("1998-08-02").cast("date")
    athletes = t.customer.join(made, k == F.col("o_custkey"), "left").select(
        k.alias("athlete_id"), pick([x[0] for x in P.LEVELS], F.col("c_nationkey") % 4).alias("level"), pick(list(P.GOALS), k % 6).alias("goal"), (k % 7 + 1).cast("int").alias("sessions_per_week"),
        F.when(k % 7 < 3, F.date_add(today, (k % 12 * 7 + k % 5).cast("int"))).alias("event_date"), "previous_phase", "adherence_pct", "make_rate", "rpe_deviation",
    )
    # over a window: joined to itself, the plan would be made twice
    peak = F.max(F.when(~F.col("is_deload"), F.col("week_number"))).over(Window.partitionBy("athlete_id"))
    out = engine.plan(athletes, today).withColumn("peak_week", peak)
    return out.select("athlete_id", "phase", "duration", "max_complexity", "week_number", "intensity_floor", "intensity_ceiling", F.round("volume_modifier", 6).alias("volume_modifier"), "reps_low", "reps_high", "is_deload", "total_reps", "peak_week")


LIFT_SQL = """
mx AS (SELECT o_custkey AS athlete_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'snatch' WHEN '2-HIGH' THEN 'clean_and_jerk' WHEN '3-MEDIUM' THEN 'back_squat' ELSE 'snatch_pull' END AS lift, max(o_totalprice) / 1000 AS weight_kg FROM orders GROUP BY 1, 2)"""
ESTIMATE_ROWS = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in P.ESTIMATES)


def lift_maxes(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    lift = F.when(p == "1-URGENT", "snatch").when(p == "2-HIGH", "clean_and_jerk").when(p == "3-MEDIUM", "back_squat").otherwise("snatch_pull")
    return t.orders.groupBy(F.col("o_custkey").alias("athlete_id"), lift.alias("lift")).agg((F.max("o_totalprice") / 1000).alias("weight_kg"))


@twin(f"""
WITH {LIFT_SQL}, e(lift, reference, ratio) AS (VALUES {ESTIMATE_ROWS})
SELECT athlete_id, lift, round(weight_kg, 6) AS weight_kg, false AS is_estimated FROM mx UNION ALL
SELECT r.athlete_id, e.lift, round_even(round_even(r.weight_kg * e.ratio::DOUBLE / 0.5, 0) * 0.5, 1), true FROM mx r JOIN e ON e.reference = r.lift WHERE NOT EXISTS (SELECT 1 FROM mx k WHERE k.athlete_id = r.athlete_id AND k.lift = e.lift)""")
def estimate_missing(t: Tables) -> DataFrame:
    return P.estimated_maxes(lift_maxes(t), ["athlete_id"]).withColumn("weight_kg", F.round("weight_kg", 6))


@twin(f"""
WITH {LIFT_SQL}, r(pct, reps, rest, rpe) AS (VALUES {", ".join(map(str, P.RAMP))}), l(no, lift) AS (VALUES (0, 'snatch'), (1, 'clean_and_jerk')), a AS (SELECT DISTINCT athlete_id FROM mx)
SELECT a.athlete_id, row_number() OVER (PARTITION BY a.athlete_id ORDER BY no, pct) AS exercise_order, l.lift, reps, rest AS rest_seconds, rpe::DOUBLE AS rpe_target, pct::DOUBLE AS intensity_pct,
  round_even(round_even(weight_kg * pct / 100 / 0.5, 0) * 0.5, 1) AS weight_kg, pct = 100 AS is_max_attempt FROM a CROSS JOIN l CROSS JOIN r LEFT JOIN mx ON mx.athlete_id = a.athlete_id AND mx.lift = l.lift""")
def max_test_ramp(t: Tables) -> DataFrame:
    return P.max_test(lift_maxes(t), ["athlete_id"], ["snatch", "clean_and_jerk"])


ROWS_SQL = f"""
e AS (SELECT DISTINCT * FROM lineitem), b AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_id, * FROM e),
r AS (SELECT row_id, l_orderkey AS session_id, o_custkey AS athlete_id, p_name AS exercise_name, l_linenumber - 1 AS exercise_order, (l_quantity::INT) % 7 AS sets, l_linenumber AS reps, l_quantity * 2 + 30 AS intensity_pct,
  CASE l_returnflag WHEN 'A' THEN 'snatch' WHEN 'N' THEN 'back_squat' ELSE 'clean' END AS ref, CASE WHEN l_tax > 0.06 THEN NULL ELSE 5 + l_tax * 50 END AS rpe, (p_size * 10)::INT AS rest FROM b JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
s AS (SELECT o_orderkey AS session_id, o_custkey AS program_id, year(o_orderdate) AS week, dayofyear(o_orderdate) AS day, 40 AS budget, CASE WHEN o_orderstatus = 'O' THEN 45 END AS minutes FROM orders),
z AS (SELECT session_id, {ZONE_NAME.format(x="intensity_pct")} AS zone, CASE WHEN intensity_pct >= 90 THEN 10 WHEN intensity_pct >= 80 THEN 20 WHEN intensity_pct >= 70 THEN 24 WHEN intensity_pct >= 65 THEN 26 ELSE 30 END AS most, sum(sets * reps) AS reps FROM r WHERE ref IN ('snatch', 'clean') AND intensity_pct > 60 GROUP BY 1, 2, 3),
wk AS (SELECT session_id, budget, sum(coalesce(zr, 0)) OVER (PARTITION BY program_id, week ORDER BY day, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM s LEFT JOIN (SELECT session_id, sum(reps) AS zr FROM z GROUP BY 1) q USING (session_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, exercise_order ORDER BY row_id) AS k FROM r), per AS (SELECT session_id, athlete_id, count(*) AS n, arg_min(ref, (exercise_order, row_id)) AS first_ref, list(DISTINCT exercise_name) AS names, sum(sets * (30 + CASE rest WHEN 0 THEN 90 ELSE rest END)) / 60.0 AS mins FROM r GROUP BY 1, 2)"""


def session_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    line = t.lineitem.distinct()
    # the twin's numbering needs one global order: the row number stands for a key that the table does not have
    row_id = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    rows = line.withColumn("row_id", row_id).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    ref = F.when(F.col("l_returnflag") == "A", "snatch").when(F.col("l_returnflag") == "N", "back_squat").otherwise("clean")
    rows = rows.select("row_id", F.col("l_orderkey").alias("session_id"), F.col("o_custkey").alias("athlete_id"), F.col("p_name").alias("exercise_name"), (F.col("l_linenumber") - 1).alias("exercise_order"), (F.col("l_quantity").cast("int") % 7).alias("sets"), F.col("l_linenumber").alias("reps"), (F.col("l_quantity") * 2 + 30).alias("intensity_pct"), ref.alias("intensity_reference"), F.when(F.col("l_tax") <= 0.06, 5 + F.col("l_tax") * 50).alias("rpe_target"), (F.col("p_size") * 10).cast("int").alias("rest_seconds"))
    sessions = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("program_id"), F.year("o_orderdate").alias("week"), F.dayofyear("o_orderdate").alias("day"), F.lit(40).alias("budget"), F.when(F.col("o_orderstatus") == "O", 45).alias("available_minutes"), F.lit(70.0).alias("week_floor"), F.lit(85.0).alias("week_ceiling"))
    return rows, sessions


@twin(f"""
WITH {ROWS_SQL}
SELECT session_id, 'sets' AS "check", 'error' AS severity, exercise_name AS subject FROM r WHERE sets < 1 UNION ALL SELECT session_id, 'intensity_range', 'error', exercise_name FROM r WHERE intensity_pct > 120
UNION ALL SELECT session_id, 'order', 'error', exercise_name FROM r WHERE exercise_order < 1 UNION ALL SELECT session_id, 'duplicate_order', 'error', exercise_order::VARCHAR FROM f WHERE k > 1 AND exercise_order >= 1
UNION ALL SELECT session_id, 'zone_volume', CASE WHEN reps > round_even(most * 1.5, 0) THEN 'error' ELSE 'warning' END, zone FROM z WHERE reps > most UNION ALL SELECT session_id, 'weekly_budget', 'warning', total::BIGINT::VARCHAR FROM wk WHERE total > budget * 1.25
UNION ALL SELECT session_id, 'above_ceiling', 'error', exercise_name FROM r WHERE ref <> 'back_squat' AND intensity_pct > 85 UNION ALL SELECT session_id, 'supramaximal', 'warning', exercise_name FROM r WHERE ref = 'back_squat' AND intensity_pct > 120
UNION ALL SELECT session_id, 'below_floor', 'warning', exercise_name FROM r WHERE ref <> 'back_squat' AND intensity_pct < 70 AND intensity_pct > 65
UNION ALL SELECT session_id, 'reps_per_set', 'error', exercise_name FROM r WHERE intensity_pct >= 90 AND reps > 2 UNION ALL SELECT session_id, 'reps_per_set', 'warning', exercise_name FROM r WHERE intensity_pct >= 80 AND intensity_pct < 90 AND reps > 4
UNION ALL SELECT session_id, 'avoided', 'error', exercise_name FROM r WHERE athlete_id % 2 = 0 AND replace(lower(exercise_name), ' ', '_') = 'red_widget'
UNION ALL SELECT session_id, 'too_many_exercises', 'warning', 'p1' FROM per WHERE n > 6 UNION ALL SELECT session_id, 'lifts_first', 'warning', 'p2' FROM per WHERE first_ref = 'back_squat'
UNION ALL SELECT session_id, 'duration', 'warning', round_even(mins, 0)::INT::VARCHAR FROM per LEFT JOIN s USING (session_id) WHERE mins > coalesce(minutes, 90) * 1.2
UNION ALL SELECT session_id, 'low_effort_target', 'warning', exercise_name FROM r WHERE (intensity_pct >= 90 AND rpe < 8) OR (intensity_pct >= 80 AND intensity_pct < 90 AND rpe < 7)
UNION ALL SELECT session_id, 'limiter_coverage', 'warning', 'squat_limited' FROM per WHERE athlete_id % 3 = 0 AND len(list_filter(names, lambda x: contains(lower(x), 'squat'))) = 0
UNION ALL SELECT session_id, 'fault_coverage', 'warning', 'slow pull' FROM per WHERE athlete_id % 5 = 0 AND NOT list_contains(list_transform(names, lambda x: lower(x)), 'small ring')""")
def validate_rows(t: Tables) -> DataFrame:
    """All checks of prescribed sessions, one row for each finding."""
    rows, sessions = session_rows(t)
    names = lambda cond, x: F.when(cond, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    k = F.col("c_custkey")
    athletes = t.customer.select(k.alias("athlete_id"), names(k % 2 == 0, "Red Widget").alias("avoid"), names(k % 3 == 0, "squat_limited").alias("strength_limiters"), names(k % 5 == 0, "slow pull").alias("technical_faults"))
    laws = t.spark.createDataFrame([("p1", 6, False), ("p2", None, True)], "rule_id string, max_exercises int, lifts_first boolean")
    return V.all_checks(rows, sessions, athletes, laws, ["Small Ring"])


@twin(f"""
WITH v AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity + 40 AS pct FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, {ZONE_NAME.format(x="pct")} AS zone, greatest(3, round_even({ZONE_CASE.format(x="(pct + 2)")} * 0.3::DOUBLE * 0.9::DOUBLE, 0))::INT AS target FROM v""")
def zone_targets(t: Tables) -> DataFrame:
    pct = F.col("l_quantity") + 40
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", P.zone_of(pct).alias("zone"), P.rep_target(pct, pct + 4, F.lit(0.3), F.lit(0.9)).alias("target"))


@twin("""
WITH f AS (SELECT DISTINCT event_type AS fault, length(event_type) % 5 AS k FROM events), x AS (SELECT p_partkey, p_name, p_size, [p_partkey % 5, (p_partkey * 3 + 1) % 5] AS addressed FROM part),
c AS (SELECT fault, p_partkey, row_number() OVER (PARTITION BY fault ORDER BY p_size, p_partkey) AS k FROM f JOIN x ON list_contains(addressed, f.k)) SELECT fault, p_partkey, k::INT AS k FROM c WHERE k <= 3""")
def faults_top3(t: Tables) -> DataFrame:
    """Each fault with the three simplest exercises that address it."""
    faults = t.events.select(F.col("event_type").alias("fault")).distinct().withColumn("code", (F.length("fault") % 5).cast("long"))
    k = F.col("p_partkey")
    addressed = t.part.select("p_partkey", "p_size", F.explode(F.array_distinct(F.array(k % 5, (k * 3 + 1) % 5))).alias("code"))
    return R.ranked(faults.join(addressed, "code"), ["fault"], F.col("p_size"), k, name="k").where("k <= 3").select("fault", "p_partkey", "k")
