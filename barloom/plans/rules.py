"""Rule tables as small DataFrames, and the expressions that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.relational import nearest

# Intensity zones (name, from, below, reps per set, best total, range of totals); the last is open above.
ZONES = [
    ("55-65", 55, 65, 3, 6, 24, 18, 30),
    ("65-70", 65, 70, 3, 6, 20, 15, 26),
    ("70-80", 70, 80, 3, 6, 18, 12, 24),
    ("80-90", 80, 90, 2, 4, 15, 10, 20),
    ("90-100", 90, None, 1, 2, 7, 4, 10),
]
# Weeks of each phase (phase, week, floor, ceiling, volume, fewest and most reps per set, deload).
WEEKS = [
    ("accumulation", 1, 68, 76, 0.85, 3, 5, False),
    ("accumulation", 2, 70, 78, 1.00, 3, 5, False),
    ("accumulation", 3, 72, 80, 1.00, 2, 5, False),
    ("accumulation", 4, 65, 73, 0.60, 2, 4, True),
    ("intensification", 1, 75, 83, 1.00, 2, 4, False),
    ("intensification", 2, 78, 86, 0.90, 2, 3, False),
    ("intensification", 3, 80, 90, 0.80, 1, 3, False),
    ("intensification", 4, 83, 93, 0.70, 1, 2, False),
    ("realization", 1, 85, 95, 0.65, 1, 2, False),
    ("realization", 2, 88, 98, 0.50, 1, 2, False),
    ("realization", 3, 70, 85, 0.35, 1, 2, True),
    ("general_prep", 1, 65, 73, 0.80, 3, 6, False),
    ("general_prep", 2, 67, 75, 0.90, 3, 6, False),
    ("general_prep", 3, 68, 77, 1.00, 3, 5, False),
    ("general_prep", 4, 70, 78, 1.00, 3, 5, False),
    ("general_prep", 5, 63, 70, 0.55, 2, 4, True),
]
# Phases in order; offset of intensity and scale of volume by level; share of volume of each day.
PHASES = ["general_prep", "accumulation", "intensification", "realization"]
LEVELS = [("beginner", -4, 1.10), ("intermediate", 0, 1.00), ("advanced", 2, 0.95), ("elite", 3, 0.90)]
DAYS = [(3, 1, 0.35), (3, 2, 0.40), (3, 3, 0.25), (4, 1, 0.30), (4, 2, 0.30), (4, 3, 0.20), (4, 4, 0.20), (5, 1, 0.25), (5, 2, 0.25), (5, 3, 0.15), (5, 4, 0.15), (5, 5, 0.20)]
# Phase and weeks by goal; ratios of a missing maximum to a known one.
GOALS = {
    "general_strength": ("accumulation", 4),
    "technique_focus": ("accumulation", 4),
    "pr_attempt": ("intensification", 4),
    "work_capacity": ("general_prep", 5),
    "return_to_sport": ("general_prep", 3),
    "competition_prep": ("intensification", 4),
}
ESTIMATES = [
    ("front_squat", "clean_and_jerk", 1.10),
    ("back_squat", "clean_and_jerk", 1.30),
    ("clean_pull", "clean_and_jerk", 1.10),
    ("clean_deadlift", "clean_and_jerk", 1.20),
    ("push_press", "clean_and_jerk", 0.75),
    ("snatch_pull", "snatch", 1.15),
    ("snatch_deadlift", "snatch", 1.25),
    ("overhead_squat", "snatch", 0.90),
    ("clean", "clean_and_jerk", 1.02),
    ("jerk", "clean_and_jerk", 1.0),
]
# Lift ratios (label, numerator, denominator, target, scale).
RATIOS = [
    ("Snatch / C&J", "snatch", "cj", 0.80, 0.83, 0.60, 1.00),
    ("Back Squat / Snatch", "back_squat", "snatch", 1.35, 1.55, 1.00, 2.50),
    ("Front Squat / Clean", "front_squat", "clean", 1.10, 1.20, 0.80, 1.60),
    ("Back Squat / C&J", "back_squat", "cj", 1.20, 1.30, 0.90, 1.80),
]
# Steps of a maximum test (percent, reps, rest, effort).
RAMP = [(50, 3, 90, 5.0), (60, 2, 90, 6.0), (70, 2, 120, 7.0), (77, 1, 180, 7.5), (83, 1, 180, 8.0), (88, 1, 240, 8.5), (93, 1, 240, 9.0), (97, 1, 300, 9.5), (100, 1, 300, 10.0)]
# Thresholds of advancing and adjusting.
MIN_ADHERENCE, MIN_SUCCESS, MAX_EFFORT, ADJUST_EFFORT, TOP_ADHERENCE, TOP_SUCCESS = 70.0, 0.75, 1.5, 1.0, 90.0, 0.85
MIN_SESSION_REPS, FIRST_WEEKS = 3, 4


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone string, low int, high int, set_low int, set_high int, optimal int, total_low int, total_high int")


def weeks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*w[:2], *map(float, w[2:5]), *w[5:]) for w in WEEKS], "phase string, week int, intensity_floor double, intensity_ceiling double, volume double, reps_low int, reps_high int, is_deload boolean")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level string, offset int, scale double")


def days(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DAYS, "sessions int, day int, share double")


def ratios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATIOS, "label string, num string, den string, target_low double, target_high double, bar_low double, bar_high double")


def estimates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ESTIMATES, "lift string, reference string, ratio double")


# Names of the measures, of the phases and of the reasons of a decision.
MEASURES = {"adherence": "Adherence", "make_rate": "Make rate", "rpe_deviation": "RPE deviation"}
PHASE_LABELS = {"general_prep": "General Prep", "accumulation": "Accumulation", "intensification": "Intensification", "realization": "Realization"}
REASONS = {
    "cold_start": "No previous phase — starting at Accumulation",
    "realization_rebuild": "Realization complete — rebuilding with Accumulation",
    "advanced": "All thresholds met — phase advanced",
    "at_top": "Already at highest phase",
}


def ramp(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(float(r[0]), *r[1:]) for r in RAMP], "pct double, reps int, rest_seconds int, rpe_target double")


def zone_of(pct: Column, field: int = 0) -> Column:
    """A field of the zone of an intensity; null below the chart."""
    out = F.lit(None)
    for row in ZONES:
        inside = pct >= row[1] if row[2] is None else (pct >= row[1]) & (pct < row[2])
        out = F.when(inside, F.lit(row[field])).otherwise(out)
    return out


def rep_target(floor: Column, ceiling: Column, share: Column, volume: Column) -> Column:
    """Competition-lift reps of a session: the best total of the middle's zone (of the lightest below the chart), scaled."""
    best = F.coalesce(zone_of((floor + ceiling) / 2, 5), F.lit(ZONES[0][5]))
    return F.greatest(F.lit(MIN_SESSION_REPS), F.rint(best * share * volume).cast("int"))


def next_phase(previous: Column, adherence: Column, success: Column, effort: Column) -> Column:
    """struct(phase, advanced, status)."""
    ready, blocked = (adherence >= MIN_ADHERENCE) & (success >= MIN_SUCCESS), effort > MAX_EFFORT
    order = F.array(*map(F.lit, PHASES))
    following = F.try_element_at(order, F.array_position(order, previous).cast("int") + 1)
    said = lambda phase, advanced, status: F.struct(phase.alias("phase"), F.lit(advanced).alias("advanced"), F.lit(status).alias("status"))
    return (
        F.when(~F.coalesce(previous.isin(PHASES), F.lit(False)), said(F.lit("accumulation"), False, "cold_start"))
        .when(previous == "realization", said(F.lit("accumulation"), False, "realization_rebuild"))
        .when(ready & ~blocked, said(following, True, "advanced"))
        .when(ready, said(previous, False, "rpe_held"))
        .otherwise(said(previous, False, "repeated"))
    )


def load_deltas(adherence: Column, success: Column, effort: Column) -> tuple[Column, Column]:
    """Changes of volume and of the intensity ceiling that an outcome implies."""
    volume = F.when(adherence < MIN_ADHERENCE, -0.10).otherwise(0.0) + F.when(effort > ADJUST_EFFORT, -0.05).otherwise(0.0)
    ceiling = F.when(success < MIN_SUCCESS, -3.0).otherwise(0.0) + F.when((adherence >= TOP_ADHERENCE) & (success >= TOP_SUCCESS), 2.0).otherwise(0.0)
    return volume, ceiling


def load_notes(adherence: Column, success: Column, effort: Column) -> Column:
    """Names of the changes that apply."""
    tests = [("volume_minus_10", adherence < MIN_ADHERENCE), ("ceiling_minus_3", success < MIN_SUCCESS), ("volume_minus_5", effort > ADJUST_EFFORT), ("ceiling_plus_2", (adherence >= TOP_ADHERENCE) & (success >= TOP_SUCCESS))]
    return F.array_compact(F.array(*[F.when(c, n) for n, c in tests]))


def verdict(previous: Column, adherence: Column, success: Column, effort: Column) -> Column:
    """struct(next, failing): the decision and the measures that are below their threshold."""
    tests = [("adherence", adherence >= MIN_ADHERENCE), ("make_rate", success >= MIN_SUCCESS), ("rpe_deviation", effort <= MAX_EFFORT)]
    failing = F.array_compact(F.array(*[F.when(~c, n) for n, c in tests]))
    return F.struct(next_phase(previous, adherence, success, effort).alias("next"), failing.alias("failing"), load_notes(adherence, success, effort).alias("adjustments"))


def verdict_reason(decision: Column, failing: Column, effort: Column) -> Column:
    """The reason of a decision (struct of next_phase) in words; failing: the names of the checks that failed."""
    status = decision["status"]
    out = F.lit(None).cast("string")
    for name, text in REASONS.items():
        out = F.when(status == name, F.lit(text)).otherwise(out)
    held = F.format_string("RPE deviation too high (%+.2f) — phase held despite good adherence and make rate", effort)
    names = F.transform(failing, lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), c))
    repeated = F.concat(F.lit("Phase repeated — "), F.array_join(names, ", "), F.lit(" below threshold"))
    return F.when(status == "rpe_held", held).when(status == "repeated", repeated).otherwise(out)


def phase_label(phase: Column) -> Column:
    """A phase in words; an unknown one is itself, none a dash."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PHASE_LABELS.items() for x in kv]), F.coalesce(phase, F.lit(""))), phase, F.lit("—"))


def default_weeks(phase: Column) -> Column:
    out = F.lit(4)
    for p in PHASES:
        out = F.when(phase == p, sum(w[0] == p for w in WEEKS)).otherwise(out)
    return out


def phase_and_weeks(weeks_out: Column, previous: Column, decided: Column, goal: Column) -> Column:
    """struct(phase, weeks): by weeks to the competition, else by the previous programme's outcome, else by goal."""
    pair = lambda p, w: F.struct(p.alias("phase"), w.cast("int").alias("weeks"))
    by_goal = pair(F.lit("accumulation"), F.lit(4))
    for name, (p, w) in GOALS.items():
        by_goal = F.when(goal == name, pair(F.lit(p), F.lit(w))).otherwise(by_goal)
    return (
        F.when(weeks_out >= 8, pair(F.lit("accumulation"), F.lit(4)))
        .when(weeks_out >= 4, pair(F.lit("intensification"), F.lit(4)))
        .when(weeks_out.isNotNull(), pair(F.lit("realization"), F.least(F.lit(3), F.greatest(F.lit(1), weeks_out))))
        .when(previous.isNotNull(), pair(decided, default_weeks(decided)))
        .otherwise(by_goal)
    )


def weekly_targets(plans: DataFrame) -> DataFrame:
    """plans (phase, duration, level, and any key) -> one row for each week, week_number from 1.

    Longer than the profile: the back half of the working weeks repeats and the deload comes last.  Shorter: early
    weeks go, and the last week is the deload if the profile has one.
    """
    spark = plans.sparkSession
    profile = weeks(spark).groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("week", "intensity_floor", "intensity_ceiling", "volume", "reps_low", "reps_high", "is_deload"))).alias("__w"))
    rows = plans.join(profile, "phase").join(levels(spark), "level", "left")
    work, rest = F.filter("__w", lambda w: ~w["is_deload"]), F.filter("__w", lambda w: w["is_deload"])
    n, have, duration = F.size(work), F.size("__w"), F.col("duration")
    mid = F.floor(n / 2).cast("int")
    # index into the working weeks, 0-based, of the i-th (from 1) working week of a longer programme
    pick = lambda i: F.when(i <= n, i - 1).otherwise(mid + (i - n - 1) % (n - mid))
    longer = F.concat(F.transform(F.sequence(F.lit(1), duration - F.size(rest)), lambda i: F.get(F.col("__work"), pick(i).cast("int"))), rest)
    rows = rows.withColumn("__work", work)
    chosen = F.when(duration > have, longer).otherwise(F.slice("__w", have - F.least(duration, have) + 1, F.least(duration, have)))
    rows = rows.withColumn("__has", F.size(rest) > 0).withColumn("__all", chosen).select(*plans.columns, "offset", "scale", "__has", F.posexplode("__all").alias("__i", "w"))
    offset, scale = F.coalesce("offset", F.lit(0)), F.coalesce("scale", F.lit(1.0))
    return rows.select(
        *plans.columns, (F.col("__i") + 1).alias("week_number"), (F.col("w.intensity_floor") + offset).alias("intensity_floor"), F.least(F.col("w.intensity_ceiling") + offset, F.lit(100.0)).alias("intensity_ceiling"),
        (F.col("w.volume") * scale).alias("volume_modifier"), F.col("w.reps_low").alias("reps_low"), F.col("w.reps_high").alias("reps_high"), (F.col("__has") & (F.col("__i") + 1 == F.col("duration"))).alias("is_deload"),
    )


def adjusted_targets(targets: DataFrame, volume: Column, ceiling: Column) -> DataFrame:
    """Targets after an outcome's changes; a deload week stays, the ceiling stays within floor and 100."""
    touched = ~F.col("is_deload") & ((volume != 0) | (ceiling != 0))
    vol = F.bround(F.greatest(F.lit(0.4), F.col("volume_modifier") + volume), 2)
    top = F.bround(F.greatest(F.col("intensity_floor"), F.least(F.lit(100.0), F.col("intensity_ceiling") + ceiling)), 1)
    return targets.withColumns({"volume_modifier": F.when(touched, vol).otherwise(F.col("volume_modifier")), "intensity_ceiling": F.when(touched, top).otherwise(F.col("intensity_ceiling"))})


def cold_start(targets: DataFrame, level: str = "level") -> DataFrame:
    """A first programme: floor and ceiling within the cap of the level."""
    cap = F.when(F.col(level) == "beginner", 75.0).otherwise(80.0)
    return targets.withColumns({"intensity_floor": F.least("intensity_floor", cap), "intensity_ceiling": F.least("intensity_ceiling", cap)})


def max_complexity(previous: Column, level: Column) -> Column:
    return F.when(previous.isNotNull(), 5).when(level == "beginner", 2).otherwise(3)


def week_totals(targets: DataFrame, sessions: str) -> DataFrame:
    """Targets with total_reps: the sum over the sessions of the nearest supported frequency."""
    spark = targets.sparkSession
    table = days(spark)
    rows = nearest(targets.withColumnRenamed(sessions, "__want"), "__want", table, "sessions")
    keys = [c for c in rows.columns if c not in ("__want", "sessions")]
    share = rows.join(table, "sessions").withColumn("__reps", rep_target(F.col("intensity_floor"), F.col("intensity_ceiling"), F.col("share"), F.col("volume_modifier")))
    return share.groupBy(*keys, F.col("__want").alias(sessions)).agg(F.sum("__reps").alias("total_reps"))


def peak_week(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Last week that is no deload, null if there is none."""
    return targets.groupBy(*keys).agg(F.max(F.when(~F.col("is_deload"), F.col("week_number"))).alias("peak_week"))


def estimated_maxes(maxes: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded maxima and, for lifts without one, estimates from the reference lift; is_estimated tells."""
    from barloom.functions.numbers import round_kg

    table = estimates(maxes.sparkSession)
    known = maxes.select(*keys, F.col("lift").alias("reference"), F.col("weight_kg").alias("__w")).where("__w > 0")
    missing = known.join(table, "reference").join(maxes.select(*keys, "lift"), [*keys, "lift"], "left_anti")
    made = missing.select(*keys, "lift", round_kg(F.col("__w") * F.col("ratio")).alias("weight_kg"), F.lit(True).alias("is_estimated"))
    return maxes.select(*keys, "lift", "weight_kg", F.lit(False).alias("is_estimated")).unionByName(made)


def max_test(maxes: DataFrame, keys: list[str], lifts: list[str]) -> DataFrame:
    """The steps of a maximum test for each of the lifts, loads from the current maxima (null without one)."""
    from pyspark.sql import Window

    from barloom.functions.numbers import resolved_weight

    spark = maxes.sparkSession
    order = spark.createDataFrame([(i, x) for i, x in enumerate(lifts)], "lift_no int, lift string")
    athletes = maxes.select(*keys).distinct()
    steps = athletes.join(order).join(ramp(spark)).join(maxes.select(*keys, "lift", F.col("weight_kg").alias("__w")), [*keys, "lift"], "left")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("lift_no", "pct"))
    return steps.select(*keys, place.alias("exercise_order"), "lift", "reps", "rest_seconds", "rpe_target", F.col("pct").alias("intensity_pct"), resolved_weight(F.col("__w"), F.col("pct")).alias("weight_kg"), (F.col("pct") == 100).alias("is_max_attempt"))
