"""Checks of prescribed sessions: one row for each finding (session_id, check, severity, subject)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import nullif_zero
from barloom.functions.numbers import session_seconds
from barloom.functions.text import plain_name
from barloom.plans.rules import ZONES, zone_of

# Fixed values of the checks.
COMP_LIFTS = ["snatch", "clean_and_jerk", "clean"]
HARD_CAP, BUDGET_TOLERANCE, DURATION_TOLERANCE, DEFAULT_MINUTES = 1.5, 1.25, 1.2, 90
SUPRAMAX, WARMUP, WARMUP_VOLUME = 120.0, 65.0, 60.0
LIMITERS = {
    "squat_limited": ["squat"],
    "pull_limited": ["pull", "deadlift", "row"],
    "overhead_limited": ["press", "overhead", "jerk"],
    "jerk_limited": ["jerk"],
    "clean_limited": ["clean"],
    "positional_strength": ["pause", "tempo", "slow"],
}
FOUND = ["session_id", "check", "severity", "subject"]


def is_comp(ref: Column | str = "intensity_reference") -> Column:
    return F.coalesce((F.col(ref) if isinstance(ref, str) else ref).isin(COMP_LIFTS), F.lit(False))


def finding(cond: Column, check: str, severity: str, subject: Column | str = "exercise_name") -> Column:
    name = F.col(subject) if isinstance(subject, str) else subject
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), name.cast("string").alias("subject")))


def rows_of(df: DataFrame, *findings: Column) -> DataFrame:
    return df.select("session_id", F.explode(F.array_compact(F.array(*findings))).alias("f")).select("session_id", "f.check", "f.severity", "f.subject")


def with_repeats(rows: DataFrame) -> DataFrame:
    """Marks the second and later rows of an order within a session."""
    again = F.row_number().over(Window.partitionBy("session_id", "exercise_order").orderBy("row_id")) > 1
    return rows.withColumn("__again", again & (F.col("exercise_order") >= 1))


def storable_findings() -> list[Column]:
    """Sets, reps and order from 1, percent in (0, 120], no order twice."""
    low = lambda c: F.coalesce(F.col(c), F.lit(0)) < 1
    pct = F.col("intensity_pct")
    return [finding(low("sets"), "sets", "error"), finding(low("reps"), "reps", "error"), finding((pct <= 0) | (pct > 120), "intensity_range", "error"), finding(low("exercise_order"), "order", "error"), finding(F.col("__again"), "duplicate_order", "error", "exercise_order")]


def zone_sums() -> list[Column]:
    """Aggregates: reps of competition lifts above warm-up intensity, one column a zone (null for none)."""
    reps = F.coalesce("sets", F.lit(0)) * F.coalesce("reps", F.lit(0))
    own = is_comp() & (F.col("intensity_pct") > WARMUP_VOLUME)
    return [F.sum(F.when(own & (zone_of(F.col("intensity_pct")) == z[0]), reps)).alias(f"zone_{i}") for i, z in enumerate(ZONES)]


def zone_findings() -> list[Column]:
    """Reps of each zone against its limit."""
    out = []
    for i, z in enumerate(ZONES):
        reps, most = F.col(f"zone_{i}"), z[7]
        cap = F.rint(F.lit(most * HARD_CAP))
        out += [finding(reps > cap, "zone_volume", "error", F.lit(z[0])), finding((reps > most) & (reps <= cap), "zone_volume", "warning", F.lit(z[0]))]
    return out


def with_running_reps(per: DataFrame) -> DataFrame:
    """Adds total_reps, the competition reps of a week up to each session (program_id, week, day); rows of no programme stand alone."""
    alone = F.when(F.col("program_id").isNull(), F.col("session_id"))
    w = Window.partitionBy("program_id", "week", alone).orderBy("day", "session_id").rowsBetween(Window.unboundedPreceding, 0)
    own = sum((F.coalesce(f"zone_{i}", F.lit(0)) for i in range(1, len(ZONES))), F.coalesce("zone_0", F.lit(0)))
    return per.withColumn("total_reps", F.sum(own).over(w))


def budget_finding() -> Column:
    """total_reps against budget."""
    return finding((F.col("budget") > 0) & (F.col("total_reps") > F.col("budget") * BUDGET_TOLERANCE), "weekly_budget", "warning", "total_reps")


def intensity_findings() -> list[Column]:
    """Against week_floor and week_ceiling, which rows have."""
    pct, comp = F.col("intensity_pct"), is_comp()
    over = pct > F.coalesce("week_ceiling", F.lit(100.0))
    under = (pct < F.coalesce("week_floor", F.lit(0.0))) & (pct > WARMUP) & comp
    return [finding(over & comp, "above_ceiling", "error"), finding(over & ~comp & (pct > SUPRAMAX), "supramaximal", "warning"), finding(under, "below_floor", "warning")]


def reps_findings() -> list[Column]:
    pct, reps = F.coalesce("intensity_pct", F.lit(0.0)), F.coalesce("reps", F.lit(0))
    return [finding((pct >= 90) & (reps > 2), "reps_per_set", "error"), finding((pct >= 80) & (pct < 90) & (reps > 4), "reps_per_set", "warning")]


def avoided_finding() -> Column:
    return finding(F.array_contains(F.transform("avoid", plain_name), plain_name(F.col("exercise_name"))), "avoided", "error")


def per_session(rows: DataFrame) -> DataFrame:
    """One aggregate for the checks of whole sessions: exercises, first reference, names, minutes, reps by zone."""
    first = F.min_by("intensity_reference", F.struct(F.coalesce("exercise_order", F.lit(2**31 - 1)), "row_id"))
    seconds = F.sum(session_seconds(F.col("sets"), F.col("rest_seconds")))
    return rows.groupBy("session_id", "athlete_id").agg(F.count(F.lit(1)).alias("n_exercises"), first.alias("first_reference"), F.collect_set(F.lower("exercise_name")).alias("names"), (seconds / 60).alias("minutes"), *zone_sums())


def rule_findings(rules: str) -> Column:
    """Array of findings of a column of rules: array<struct<rule_id, max_exercises, lifts_first>>."""
    known = F.col("n_exercises").isNotNull()

    def broken(r: Column) -> Column:
        over = known & (r["max_exercises"] > 0) & (F.col("n_exercises") > r["max_exercises"])
        return F.array(finding(over, "too_many_exercises", "warning", r["rule_id"]), finding(known & r["lifts_first"] & ~is_comp("first_reference"), "lifts_first", "warning", r["rule_id"]))

    return F.flatten(F.transform(rules, broken))


def duration_finding() -> Column:
    """minutes against available_minutes."""
    most = F.coalesce(nullif_zero(F.col("available_minutes")), F.lit(DEFAULT_MINUTES)) * DURATION_TOLERANCE
    return finding(F.col("minutes") > most, "duration", "warning", F.bround("minutes", 0).cast("int"))


def effort_findings() -> list[Column]:
    pct, rpe = F.coalesce("intensity_pct", F.lit(0.0)), F.col("rpe_target")
    return [finding((pct >= 90) & (rpe < 8), "low_effort_target", "warning"), finding((pct >= 80) & (pct < 90) & (rpe < 7), "low_effort_target", "warning")]


def fault_finding(fault_names: Sequence[str]) -> Column:
    """names against exercises for the athlete's technical_faults."""
    known = F.array(*[F.lit(n.lower()) for n in fault_names]).cast("array<string>")
    return finding((F.size("technical_faults") > 0) & (F.size(F.array_intersect("names", known)) == 0), "fault_coverage", "warning", F.array_join("technical_faults", ", "))


def limiter_findings() -> list[Column]:
    """names against the athlete's strength_limiters."""
    from barloom.functions.text import limiter_covered

    return [finding(F.array_contains("strength_limiters", name) & ~limiter_covered(F.col("names"), words), "limiter_coverage", "warning", F.lit(name)) for name, words in LIMITERS.items()]


def all_checks(rows: DataFrame, sessions: DataFrame, athletes: DataFrame, rules: DataFrame, fault_names: Sequence[str] | None = None) -> DataFrame:
    """All findings, from one pass over the rows and one aggregate by session.

    rows: row_id, session_id, athlete_id and the exercise columns; sessions: session_id, program_id, week, day, budget,
    available_minutes, week_floor, week_ceiling; athletes: athlete_id, avoid, strength_limiters, technical_faults.
    """
    wide = with_repeats(rows).join(sessions.select("session_id", "week_floor", "week_ceiling"), "session_id", "left").join(athletes.select("athlete_id", "avoid"), "athlete_id", "left")
    by_row = rows_of(wide, *storable_findings(), *intensity_findings(), *reps_findings(), avoided_finding(), *effort_findings())
    known = per_session(rows).withColumnRenamed("session_id", "__s").join(sessions.select("session_id", "program_id", "week", "day", "budget", "available_minutes"), F.col("__s") == F.col("session_id"), "full_outer")
    known = with_running_reps(known.withColumn("session_id", F.coalesce("session_id", "__s")).drop("__s")).join(athletes.drop("avoid"), "athlete_id", "left")
    faults = [] if fault_names is None else [fault_finding(fault_names)]
    single = F.array(duration_finding(), budget_finding(), *zone_findings(), *limiter_findings(), *faults)
    # the rule table, a few rows, comes in as a scalar subquery
    laws = rules.agg(F.collect_list(F.struct("rule_id", "max_exercises", "lifts_first"))).scalar()
    found = F.array_compact(F.concat(single, rule_findings("__rules")))
    by_session = known.withColumn("__rules", laws).select("session_id", F.explode(found).alias("f")).select("session_id", "f.check", "f.severity", "f.subject")
    return by_row.unionByName(by_session)
