"""Analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import dates as D
from barloom.functions import numbers as N
from barloom.operators import analytics as A
from barloom.operators import relational as R
from barloom.plans import rules
from barloom.queries.registry import Tables, twin


@twin("""
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS attempts,
       count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed,
       (array_agg(props ORDER BY ts DESC, event_id DESC) FILTER (WHERE props IS NOT NULL))[1] AS last_message,
       round(coalesce(sum(value), 0), 6) AS total_cost, date_diff('microsecond', min(ts), max(ts)) / 1000000.0 AS duration_seconds
FROM events GROUP BY user_id ORDER BY started_at DESC, user_id LIMIT 100""")
def filtered_counts_last_error(t: Tables) -> DataFrame:
    """Roll-up of attempts by user: the admin view."""
    bad = F.col("event_type") == "error"
    out = A.rollup_of_attempts(t.events, "user_id", "ts", ~bad, bad, F.col("props"), "event_id", F.col("value"))
    return out.withColumn("total_cost", F.round("total_cost", 6)).orderBy(F.desc("started_at"), "user_id").limit(100)


@twin("""
SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS open_max, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS final_max,
       max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS part_max FROM orders GROUP BY o_custkey""")
def pivot_max_by_status(t: Tables) -> DataFrame:
    return A.conditional_pivot(t.orders, ["o_custkey"], "o_orderstatus", "o_totalprice", {"open_max": "O", "final_max": "F", "part_max": "P"})


@twin("""
WITH w AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS snatch, max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS cj,
  max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS back_squat, max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END) AS front_squat,
  max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS clean FROM orders GROUP BY 1),
c AS (SELECT o_custkey, 'Snatch / C&J' AS label, snatch AS n, cj AS d, 0.80 AS lo, 0.83 AS hi, 0.60 AS bl, 1.00 AS bh FROM w
  UNION ALL SELECT o_custkey, 'Back Squat / Snatch', back_squat, snatch, 1.35, 1.55, 1.00, 2.50 FROM w
  UNION ALL SELECT o_custkey, 'Front Squat / Clean', front_squat, clean, 1.10, 1.20, 0.80, 1.60 FROM w
  UNION ALL SELECT o_custkey, 'Back Squat / C&J', back_squat, cj, 1.20, 1.30, 0.90, 1.80 FROM w),
v AS (SELECT *, round_even(n / d, 2) AS value FROM c WHERE n IS NOT NULL AND d IS NOT NULL AND d <> 0)
SELECT o_custkey, label, value, lo::DOUBLE AS target_low, hi::DOUBLE AS target_high, CASE WHEN value < lo THEN 'low' WHEN value > hi THEN 'high' ELSE 'ok' END AS status FROM v""")
def ratio_checks(t: Tables) -> DataFrame:
    names = {"snatch": "1-URGENT", "cj": "2-HIGH", "back_squat": "3-MEDIUM", "front_squat": "4-NOT SPECIFIED", "clean": "5-LOW"}
    wide = A.conditional_pivot(t.orders, ["o_custkey"], "o_orderpriority", "o_totalprice", names)
    return A.ratio_checks(wide, ["o_custkey"], rules.ratios(t.spark), list(names)).drop("value_pct")


@twin("""
WITH p AS (SELECT o_custkey, count(*) AS planned FROM orders GROUP BY 1),
d AS (SELECT o_custkey, count(*) AS log_rows, count(DISTINCT o_orderkey) AS completed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_custkey, planned, coalesce(completed, 0) AS completed, round(coalesce(completed, 0) * 100.0 / planned, 4) AS adherence_pct,
       round(coalesce(log_rows, 0) * 100.0 / planned, 4) AS rows_pct FROM p LEFT JOIN d USING (o_custkey)""")
def adherence(t: Tables) -> DataFrame:
    """By distinct sessions, and by log rows."""
    planned = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("planned"))
    logged = t.orders.select("o_custkey", "o_orderkey").join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    done = logged.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("log_rows"), F.countDistinct("o_orderkey").alias("completed"))
    out = planned.join(done, "o_custkey", "left").na.fill(0, ["log_rows", "completed"])
    pct = lambda c: F.round(N.adherence(F.col(c), F.col("planned")), 4)
    return out.select("o_custkey", "planned", "completed", pct("completed").alias("adherence_pct"), pct("log_rows").alias("rows_pct"))


@twin("""
SELECT l_partkey, round(avg(l_discount), 6) AS avg_discount, count(l_discount) AS n_discount, round(avg(CASE WHEN l_returnflag = 'R' THEN l_tax END), 6) AS avg_tax,
       count(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS n_tax FROM lineitem WHERE l_discount > 0.02 OR l_returnflag = 'R'
GROUP BY l_partkey HAVING count(l_discount) >= 30 OR count(CASE WHEN l_returnflag = 'R' THEN l_tax END) >= 10""")
def having_either_metric(t: Tables) -> DataFrame:
    tax = F.when(F.col("l_returnflag") == "R", F.col("l_tax"))
    rows = t.lineitem.where((F.col("l_discount") > 0.02) | (F.col("l_returnflag") == "R"))
    out = rows.groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("l_discount").alias("n_discount"), F.round(F.avg(tax), 6).alias("avg_tax"), F.count(tax).alias("n_tax"))
    return out.where("n_discount >= 30 OR n_tax >= 10")


@twin("""
WITH a AS (SELECT l_orderkey, count(*) AS sets, list(l_quantity::INT ORDER BY l_quantity) AS reps FROM lineitem GROUP BY 1)
SELECT l_orderkey, sum(CASE WHEN len(reps) = 1 THEN 4 * reps[1] ELSE coalesce(list_sum(reps), 0) END)::BIGINT AS reps FROM a GROUP BY 1""")
def weekly_reps_dual_encoding(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("reps_per_set"))
    return A.weekly_reps(rows.withColumn("sets", F.lit(4)), ["l_orderkey"])


@twin("""
WITH l AS (SELECT *, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS d FROM lineitem),
p AS (SELECT floor(d / 7.0)::INT AS week, round(sum(l_linenumber * l_quantity * l_tax), 6) AS prescribed FROM l WHERE l_returnflag = 'N' GROUP BY 1),
a AS (SELECT floor(d / 7.0)::INT AS week, round(sum(l_linenumber * ((l_quantity + l_discount) / 2) * l_tax), 6) AS actual FROM l WHERE l_returnflag = 'R' GROUP BY 1)
SELECT week, coalesce(prescribed, 0) AS prescribed, actual FROM p FULL OUTER JOIN a USING (week)""")
def tonnage_full_outer(t: Tables) -> DataFrame:
    """Weekly planned tonnage, 0 where there is none, beside the actual, null where there is none."""
    rows = t.lineitem.withColumn("week", F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) / 7).cast("int"))
    rows = rows.select("week", "l_returnflag", F.col("l_linenumber").alias("sets"), F.col("l_quantity").cast("string").alias("reps"), F.array("l_quantity", "l_discount").alias("reps_per_set"), F.col("l_tax").alias("weight_kg"))
    a, b = A.tonnage_planned(rows.where("l_returnflag = 'N'"), ["week"]), A.tonnage_done(rows.where("l_returnflag = 'R'"), ["week"])
    both = R.merged_sides(a, b, ["week"], ["prescribed"])
    return both.select("week", F.round("prescribed", 6).alias("prescribed"), F.round("actual", 6).alias("actual"))


@twin("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE rn <= 6),
h AS (SELECT user_id, n, avg(value) FILTER (WHERE i > n // 2) - avg(value) FILTER (WHERE i <= n // 2) AS diff FROM l GROUP BY user_id, n)
SELECT user_id, CASE WHEN n < 3 THEN 'stable' WHEN diff > 0.5 THEN 'ascending' WHEN diff < -0.5 THEN 'descending' ELSE 'stable' END AS trend FROM h""")
def trend_last6(t: Tables) -> DataFrame:
    rows = A.last_values(t.events, ["user_id"], ["ts", "event_id"], "value", 6, "v")
    return rows.select("user_id", A.trend(F.col("v"), A.RPE_TREND).alias("trend"))


@twin("""
WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
g AS (SELECT o_custkey, count(*) AS total, max(v) AS best, max(v) FILTER (WHERE rn = 1) AS latest, avg(v) FILTER (WHERE rn <= 3) AS recent, avg(v) FILTER (WHERE rn BETWEEN 4 AND 6) AS earlier FROM r GROUP BY 1)
SELECT o_custkey, total, best, latest, round(recent, 4) AS recent, round(earlier, 4) AS earlier,
       CASE WHEN total <= 3 THEN 'stable' WHEN recent - earlier > 1.5 THEN 'up' WHEN recent - earlier < -1.5 THEN 'down' ELSE 'stable' END AS trend FROM g""")
def history_band_trend(t: Tables) -> DataFrame:
    out = A.banded_trend(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice")
    return out.withColumns({"recent": F.round("recent", 4), "earlier": F.round("earlier", 4)})


@twin("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE trim(event_type) <> '')
SELECT user_id, string_agg(event_type, ' | ' ORDER BY rn) AS notes FROM r WHERE rn <= 5 GROUP BY user_id""")
def top5_note_concat(t: Tables) -> DataFrame:
    return A.top_notes(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], "event_type")


@twin("""
WITH l AS (SELECT l_orderkey, date_trunc('week', l_shipdate)::DATE AS week, l_quantity, l_extendedprice FROM lineitem),
w AS (SELECT l_orderkey, week, sum(l_quantity) AS q FROM l GROUP BY 1, 2)
SELECT l_orderkey, round(avg(q), 4) AS avg_weekly FROM w GROUP BY 1""")
def average_of_weekly_sums(t: Tables) -> DataFrame:
    weekly = t.lineitem.groupBy("l_orderkey", F.trunc(F.to_date("l_shipdate"), "week").alias("week")).agg(F.sum("l_quantity").alias("q"))
    return weekly.groupBy("l_orderkey").agg(F.round(F.avg("q"), 4).alias("avg_weekly"))


@twin("""
SELECT o_orderpriority, round_even(avg(o_totalprice), 2) AS mean, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
       max(o_orderstatus) FILTER (WHERE o_totalprice > 100000) AS last_status, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order FROM orders GROUP BY 1""")
def mean_and_latest_by_key(t: Tables) -> DataFrame:
    latest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_orderpriority").agg(
        F.bround(F.avg("o_totalprice"), 2).alias("mean"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.max(F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus"))).alias("last_status"), latest.alias("latest_order")
    )


@twin("""
WITH f AS (SELECT o_custkey AS athlete, o_orderkey AS id, o_orderdate::DATE AS day, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
d AS (SELECT athlete, 'high_effort' AS kind, day::VARCHAR AS subject, o_totalprice AS value FROM f WHERE o_totalprice >= 400000),
e AS (SELECT athlete, l_partkey, avg(l_discount) AS m, count(l_discount) AS n FROM f JOIN lineitem ON l_orderkey = id GROUP BY 1, 2)
SELECT * FROM d UNION ALL SELECT athlete, 'low_make_rate', l_partkey::VARCHAR, round_even(m * 100, 0) FROM e WHERE n >= 2 AND m < 0.03""")
def warnings_like(t: Tables) -> DataFrame:
    """The shape of the warnings list on orders: daily flags and averages with a sample gate, in one union."""
    recent = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").select(F.col("o_custkey").alias("athlete"), "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    daily = recent.where("o_totalprice >= 400000").select("athlete", F.lit("high_effort").alias("kind"), F.col("day").cast("string").alias("subject"), F.col("o_totalprice").alias("value"))
    stats = recent.join(t.lineitem.select("l_orderkey", "l_partkey", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("athlete", "l_partkey").agg(F.avg("l_discount").alias("m"), F.count("l_discount").alias("n"))
    low = stats.where("n >= 2 AND m < 0.03").select("athlete", F.lit("low_make_rate").alias("kind"), F.col("l_partkey").cast("string").alias("subject"), F.bround(F.col("m") * 100, 0).alias("value"))
    return daily.unionByName(low)


@twin("""
WITH logs AS (SELECT event_id AS log_id, user_id AS athlete_id, ts::DATE AS log_date, CASE WHEN value > 90 THEN 9.5 ELSE 7.0 END AS rpe, (event_id % 6)::INT AS sleep, (event_id % 5)::INT AS stress, event_type, value FROM events),
r AS (SELECT * FROM logs WHERE log_date >= DATE '2024-01-17'),
d AS (SELECT athlete_id, 'high_effort' AS kind, log_date::VARCHAR AS subject, rpe::DOUBLE AS value FROM r WHERE rpe >= 9
  UNION ALL SELECT athlete_id, 'poor_sleep', log_date::VARCHAR, sleep::DOUBLE FROM r WHERE sleep <> 0 AND sleep <= 2
  UNION ALL SELECT athlete_id, 'high_stress', log_date::VARCHAR, stress::DOUBLE FROM r WHERE stress >= 4),
s AS (SELECT athlete_id, event_type, avg(CASE WHEN log_id % 3 = 0 THEN value / 20 END) AS dv, avg(CASE WHEN log_id % 2 = 0 THEN value / 100 END) AS m, count(CASE WHEN log_id % 3 = 0 THEN 1 END) AS nd, count(CASE WHEN log_id % 2 = 0 THEN 1 END) AS nm
  FROM r WHERE log_id % 3 = 0 OR log_id % 2 = 0 GROUP BY 1, 2)
SELECT * FROM d UNION ALL SELECT athlete_id, 'effort_above_target', event_type, round_even(dv, 1) FROM s WHERE nd >= 2 AND dv > 1.5
UNION ALL SELECT athlete_id, 'low_make_rate', event_type, round_even(m * 100, 0) FROM s WHERE nm >= 2 AND m < 0.7""")
def warnings_list(t: Tables) -> DataFrame:
    e = t.events
    logs = e.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("athlete_id"), F.to_date("ts").alias("log_date"), F.when(F.col("value") > 90, 9.5).otherwise(7.0).alias("overall_rpe"), (F.col("event_id") % 6).alias("sleep_quality"), (F.col("event_id") % 5).alias("stress_level"))
    third, half = F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0
    entries = e.select(F.col("event_id").alias("log_id"), F.col("event_type").alias("exercise"), F.when(third, F.col("value")).alias("rpe"), F.when(third, F.col("value") / 20).alias("rpe_deviation"), F.when(half, F.col("value") / 100).alias("make_rate"))
    return A.warning_rows(logs, entries, F.lit("2024-01-31").cast("date"))


@twin("""
WITH s AS (SELECT o_custkey AS program_id, o_orderkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
w AS (SELECT *, (i // 3)::INT AS week FROM s),
x AS (SELECT program_id, week, i, session_id, l_linenumber AS pos, l_extendedprice AS ep, l_partkey AS pk, l_discount * 19.71831::DOUBLE AS dev, l_tax * 11.31371::DOUBLE AS mk, l_quantity::INT AS q
  FROM w JOIN (SELECT DISTINCT * FROM lineitem) ON l_orderkey = session_id),
y AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY week DESC, i DESC, pos DESC, ep DESC, pk DESC, q DESC, dev DESC, mk DESC) AS rn FROM x),
z AS (SELECT program_id, dev, mk, row_number() OVER (PARTITION BY program_id ORDER BY rn DESC) AS j, count(*) OVER (PARTITION BY program_id) AS n FROM y WHERE rn <= 6),
tr AS (SELECT program_id, n, avg(dev) FILTER (WHERE j > n // 2) - avg(dev) FILTER (WHERE j <= n // 2) AS dd, avg(mk) FILTER (WHERE j > n // 2) - avg(mk) FILTER (WHERE j <= n // 2) AS dm FROM z GROUP BY 1, 2),
wk AS (SELECT program_id, avg(r) AS reps FROM (SELECT program_id, week, sum(3 * q) AS r FROM x GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT program_id, avg(dev) AS d, avg(mk) AS mk, count(DISTINCT session_id) AS completed FROM x GROUP BY 1),
p AS (SELECT program_id, count(*) AS planned FROM w GROUP BY 1)
SELECT p.program_id, planned, coalesce(completed, 0) AS completed, round_even(coalesce(completed, 0) * 100.0 / planned, 1) AS adherence_pct,
  round_even(coalesce(d, 0), 2) AS avg_rpe_deviation, round_even(coalesce(m.mk, 0), 2) AS avg_make_rate, round_even(coalesce(reps, 0), 1) AS avg_weekly_reps,
  CASE WHEN n >= 3 AND dd > 0.5 THEN 'ascending' WHEN n >= 3 AND dd < -0.5 THEN 'descending' ELSE 'stable' END AS rpe_trend,
  CASE WHEN n >= 3 AND dm > 0.07 THEN 'ascending' WHEN n >= 3 AND dm < -0.07 THEN 'descending' ELSE 'stable' END AS make_rate_trend
FROM p LEFT JOIN m USING (program_id) LEFT JOIN wk USING (program_id) LEFT JOIN tr USING (program_id)""")
def program_outcomes(t: Tables) -> DataFrame:
    """The whole outcome assembly, a customer's orders standing for a programme's sessions."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    sessions = t.orders.select(F.col("o_custkey").alias("program_id"), F.col("o_orderkey").alias("session_id"), i.alias("day")).withColumn("week", F.floor(F.col("day") / 3).cast("int"))
    rows = t.lineitem.distinct()
    logs = rows.select(F.col("l_orderkey").alias("log_id"), F.col("l_orderkey").alias("session_id")).distinct()
    place = F.struct("l_linenumber", "l_extendedprice", "l_partkey", F.col("l_quantity").cast("int"), F.col("l_discount") * 19.71831, F.col("l_tax") * 11.31371)
    entries = rows.select(F.col("l_orderkey").alias("log_id"), place.alias("position"), F.lit(0).alias("entry_id"), (F.col("l_discount") * 19.71831).alias("rpe_deviation"), (F.col("l_tax") * 11.31371).alias("make_rate"), F.lit(3).alias("sets"), F.array(F.col("l_quantity").cast("int")).alias("reps_per_set"))
    return A.outcomes(sessions, logs, entries)


@twin("""
WITH a AS (SELECT l_partkey, max(l_quantity) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01' GROUP BY 1),
c AS (SELECT l_partkey, max(l_quantity) AS e FROM lineitem GROUP BY 1)
SELECT l_partkey, b AS before, e AS after, round_even(e - b, 1) AS delta FROM a JOIN c USING (l_partkey) WHERE round_even(e - b, 1) <> 0""")
def maxes_before_after(t: Tables) -> DataFrame:
    before = t.lineitem.where("l_shipdate < TIMESTAMP_NTZ '1995-06-01'").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    return A.before_after(before, t.lineitem.groupBy("l_partkey").agg(F.max("l_quantity").alias("q")), ["l_partkey"], "q")


@twin("""
SELECT o_orderkey, least(30, greatest(1, floor(date_diff('day', o_orderdate::DATE, DATE '1998-08-02') / 7.0)::INT + 1)) AS week_index,
  greatest(1, floor(date_diff('day', o_orderdate::DATE, DATE '1998-08-02') / 7.0)::INT + 1) AS open_week_index FROM orders""")
def week_index(t: Tables) -> DataFrame:
    day, today = F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date")
    return t.orders.select("o_orderkey", D.week_index(day, today, F.lit(30)).alias("week_index"), D.open_week_index(day, today).alias("open_week_index"))


@twin("""
SELECT o_orderkey, CASE WHEN date_diff('day', DATE '1996-06-01', o_orderdate::DATE) >= 0 THEN floor(date_diff('day', DATE '1996-06-01', o_orderdate::DATE) / 7.0)::INT END AS weeks_out,
  CASE WHEN o_orderdate::DATE BETWEEN DATE '1996-06-01' - 365 AND DATE '1996-06-01' THEN o_orderdate::DATE ELSE DATE '1996-06-01' END AS log_date, o_orderdate::DATE >= DATE '1996-06-01' - 14 AS within_14 FROM orders""")
def weeks_out(t: Tables) -> DataFrame:
    day, today = F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date")
    return t.orders.select("o_orderkey", D.weeks_out(day, today).alias("weeks_out"), D.clamped_log_date(day.cast("string"), today).alias("log_date"), D.within_days(day, today, 14).alias("within_14"))


@twin("""
SELECT p_partkey, round_even(round_even(p_retailprice / 0.5, 0) * 0.5, 1) AS rounded, CASE WHEN p_size <> 0 AND p_retailprice <> 0 THEN round_even(round_even(p_retailprice * p_size / 100 / 0.5, 0) * 0.5, 1) END AS resolved,
  greatest(0, least(100, round_even((p_size - 10) / 30.0 * 100, 0)))::INT AS scaled, CASE WHEN p_size <> 0 THEN round_even(p_retailprice - p_size, 2) END AS deviation, round(p_size * 3e-6 + p_partkey * 1.5e-5, 9) AS cost, greatest(0, 30 - p_size) AS remaining FROM part""")
def round_kg(t: Tables) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return t.part.select(
        "p_partkey", N.round_kg(price).alias("rounded"), N.resolved_weight(price, size).alias("resolved"), N.scaled_pct(size, F.lit(10), F.lit(40)).alias("scaled"),
        N.deviation(price, size, 2).alias("deviation"), F.round(N.token_cost(size, F.col("p_partkey")), 9).alias("cost"), N.remaining(F.lit(30), size).alias("remaining"),
    )


@twin("""
WITH s AS (SELECT l_orderkey, sum(l_linenumber * (30 + CASE WHEN l_quantity < 10 THEN 90 ELSE l_quantity::INT END)) AS seconds FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(seconds / 60.0, 4) AS minutes FROM s""")
def session_minutes(t: Tables) -> DataFrame:
    rest = F.when(F.col("l_quantity") < 10, F.lit(None)).otherwise(F.col("l_quantity").cast("int"))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(N.session_seconds(F.col("l_linenumber"), rest)) / 60, 4).alias("minutes"))
