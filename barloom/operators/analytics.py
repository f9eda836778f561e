"""Training analytics: outcomes, trends, volumes, ratios, warnings, audits; always over all entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import present, round_even
from barloom.functions.numbers import adherence, dual_reps, mean_of, representative_reps, scaled_pct

RPE_TREND, SUCCESS_TREND = 0.5, 0.07


def trend(values: Column, threshold: float, invert: bool = False) -> Column:
    """ascending / descending / stable: mean of the second half of an array against that of the first."""
    n, half = F.size(values), F.floor(F.size(values) / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    diff = F.when(n >= 3, mean(F.slice(values, half + 1, n - half)) - mean(F.slice(values, 1, half)))
    diff = -diff if invert else diff
    return F.when(diff > threshold, "ascending").when(diff < -threshold, "descending").otherwise("stable")


def last_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """keys and the array of the last n values in order; the order has to be unique."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("at"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(name))


def conditional_pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, names: dict[str, str]) -> DataFrame:
    """One column for each named entry: its largest value."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(c) for c, n in names.items()])


def ratio_checks(wide: DataFrame, keys: Sequence[str], checks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ratios of columns against a rule table: label, num, den, target_low, target_high, bar_low, bar_high."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    tall = wide.select(*keys, cells.alias("__x")).select(*keys, "__x.c", "__x.v")
    num = tall.select(*keys, F.col("c").alias("num"), F.col("v").alias("numerator"))
    den = tall.select(*keys, F.col("c").alias("den"), F.col("v").alias("denominator"))
    rows = num.join(checks, "num").join(den, [*keys, "den"]).where(F.col("numerator").isNotNull() & present(F.col("denominator")))
    value = F.bround(F.col("numerator") / F.col("denominator"), 2)
    rows = rows.withColumn("value", value)
    status = F.when(F.col("value") < F.col("target_low"), "low").when(F.col("value") > F.col("target_high"), "high").otherwise("ok")
    return rows.select(*keys, "label", "value", "target_low", "target_high", status.alias("status"), scaled_pct(F.col("value"), F.col("bar_low"), F.col("bar_high")).alias("value_pct"))


def weekly_reps(entries: DataFrame, keys: Sequence[str], sets: str = "sets", reps: str = "reps_per_set") -> DataFrame:
    """Sum of reps by key; rows without an array do not count."""
    return entries.where(F.col(reps).isNotNull()).groupBy(*keys).agg(F.sum(dual_reps(F.col(sets), F.col(reps))).alias("reps"))


def tonnage_planned(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col("sets") * representative_reps(F.col("reps")) * F.col("weight_kg")).alias("prescribed"))


def tonnage_done(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    good = rows.where(F.size("reps_per_set") > 0)
    return good.groupBy(*keys).agg(F.sum(F.col("sets") * mean_of(F.col("reps_per_set").cast("array<double>")) * F.col("weight_kg")).alias("actual"))


def banded_trend(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, band: int = 3, threshold: float = 1.5) -> DataFrame:
    """count, best, latest and the trend of the newest ``band`` rows against the next; needs more rows than one band."""
    rows = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    v, rn = F.col(value), F.col("__rn")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.max(v).alias("best"), F.max(F.when(rn == 1, v)).alias("latest"),
        F.avg(F.when(rn <= band, v)).alias("recent"), F.avg(F.when((rn > band) & (rn <= 2 * band), v)).alias("earlier"),
    )
    diff = F.when(F.col("total") > band, F.col("recent") - F.col("earlier"))
    return out.withColumn("trend", F.when(diff > threshold, "up").when(diff < -threshold, "down").otherwise("stable"))


def top_notes(df: DataFrame, keys: Sequence[str], order: Sequence[Column], note: str, n: int = 5, sep: str = " | ") -> DataFrame:
    """The first n non-empty notes joined in order."""
    rows = df.where(F.trim(F.coalesce(F.col(note), F.lit(""))) != "")
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct("__rn", note)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda s: s[note]), sep).alias("notes"))


def rollup_of_attempts(df: DataFrame, key: str, at: str, ok: Column, failed: Column, message: Column, tie: str, cost: Column) -> DataFrame:
    """Attempts by key: first and last time, seconds between, counts by result, latest message, total cost."""
    out = df.groupBy(key).agg(
        F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("succeeded"), F.count_if(failed).alias("failed"),
        F.max_by(message, F.when(message.isNotNull(), F.struct(at, tie))).alias("last_message"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"),
    )
    return out.withColumn("duration_seconds", F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ended_at")) / 1_000_000)


def last_text(rows: DataFrame, keys: Sequence[str], text: Column, counts: Column, n: int) -> DataFrame:
    """The n keys with most rows that count, and the largest of their texts (by character order, not by time)."""
    out = rows.groupBy(*keys).agg(F.max(F.when(counts, text)).alias("largest_text"), F.count_if(counts).alias("n"))
    return out.orderBy(F.desc("n"), *keys).limit(n)


def overshoot(entries: DataFrame, keys: Sequence[str], actual: str = "rpe", target: str = "rpe_target", least: float = 1.0) -> DataFrame:
    """Exercises whose mean effort is more than ``least`` above target, over the rows that have both."""
    rows = entries.where(F.col(actual).isNotNull() & F.col(target).isNotNull())
    out = rows.groupBy(*keys).agg(F.avg(F.col(actual) - F.col(target)).alias("avg_overshoot"), F.count(F.lit(1)).alias("sessions"))
    return out.where(F.col("avg_overshoot") > least)


def make_rates_by_week(entries: DataFrame, exercises: DataFrame, category: str = "competition") -> DataFrame:
    """Mean make rate by exercise and week, for the exercises of a category."""
    own = exercises.where(F.col("category") == category).select(F.col("id").alias("__e"))
    rows = entries.join(own, F.col("exercise_id") == F.col("__e"), "left_semi")
    return rows.groupBy("exercise_name", "week_number").agg(F.avg("make_rate").alias("avg_make_rate"))


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Non-zero differences of values that both snapshots have."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, list(keys)).withColumn("delta", F.bround(F.col("after") - F.col("before"), 1)).where("delta <> 0")


def snapshot_rows(df: DataFrame, keys: Sequence[str], snapshot: str, value: str = "value") -> DataFrame:
    """A JSON map of numbers as rows with lower-case, underscored names."""
    entries = F.explode(F.from_json(F.col(snapshot), "map<string,double>")).alias("__k", value)
    return df.select(*keys, entries).withColumn("name", F.replace(F.lower("__k"), F.lit(" "), F.lit("_"))).drop("__k")


def outcomes(sessions: DataFrame, logs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each programme.

    sessions: program_id, session_id, week, day.  logs: log_id, session_id.  entries: entry_id, log_id, lift,
    position, rpe_deviation, make_rate, sets, reps_per_set.  Averages of nothing are 0.
    """
    planned = sessions.groupBy("program_id").agg(F.count(F.lit(1)).alias("planned"))
    logged = sessions.join(logs, "session_id")
    done = logged.groupBy("program_id").agg(F.countDistinct("session_id").alias("completed"))
    # entries are dealt by programme once: place of each value from the end, then one aggregate by week and one over weeks
    newest = Window.partitionBy("program_id").orderBy(*[F.col(c).desc() for c in ("week", "day", "position", "entry_id")])
    rows = logged.join(entries, "log_id")
    for c in ("rpe_deviation", "make_rate"):
        rows = rows.withColumn(f"__{c}", F.when(F.col(c).isNotNull(), F.count(c).over(newest.rowsBetween(Window.unboundedPreceding, 0))))
    last = lambda c: F.collect_list(F.when(F.col(f"__{c}") <= 6, F.struct((-F.col(f"__{c}")).alias("at"), F.col(c).cast("double").alias("v"))))
    by_week = rows.groupBy("program_id", "week").agg(
        F.sum("rpe_deviation").alias("__ds"), F.count("rpe_deviation").alias("__dn"), F.sum("make_rate").alias("__ms"), F.count("make_rate").alias("__mn"),
        F.sum(F.when(F.col("reps_per_set").isNotNull(), dual_reps(F.col("sets"), F.col("reps_per_set")))).alias("__reps"), last("rpe_deviation").alias("__d6"), last("make_rate").alias("__m6"),
    )
    ordered = lambda c: F.transform(F.array_sort(F.flatten(F.collect_list(c))), lambda x: x["v"])
    means = by_week.groupBy("program_id").agg(
        F.try_divide(F.sum("__ds"), F.sum("__dn")).alias("__d"), F.try_divide(F.sum("__ms"), F.sum("__mn")).alias("__m"), F.avg("__reps").alias("__reps"),
        ordered("__d6").alias("__efforts"), ordered("__m6").alias("__makes"),
    )
    out = planned.join(done, "program_id", "left").join(means, "program_id", "left")
    zero = lambda c, n: F.bround(F.coalesce(F.col(c), F.lit(0.0)), n)
    none = F.array().cast("array<double>")
    return out.select(
        "program_id", "planned", F.coalesce("completed", F.lit(0)).alias("completed"), F.bround(adherence(F.coalesce("completed", F.lit(0)), F.col("planned")), 1).alias("adherence_pct"),
        zero("__d", 2).alias("avg_rpe_deviation"), zero("__m", 2).alias("avg_make_rate"), zero("__reps", 1).alias("avg_weekly_reps"),
        trend(F.coalesce("__efforts", none), RPE_TREND).alias("rpe_trend"), trend(F.coalesce("__makes", none), SUCCESS_TREND).alias("make_rate_trend"),
    )


def success_by_lift(entries: DataFrame, keys: Sequence[str], lift: str = "lift") -> DataFrame:
    return entries.where(F.col("make_rate").isNotNull()).groupBy(*keys, lift).agg(F.bround(F.avg("make_rate"), 2).alias("make_rate"))


def warning_rows(logs: DataFrame, entries: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """athlete_id, kind, subject, value: one row for each warning of the last days.  Means add up in order of log_id, wherever rows lie."""
    recent = logs.where(F.col("log_date") >= F.date_sub(as_of, days))
    day = F.col("log_date").cast("string")

    def when(cond: Column, kind: str, value: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("kind"), day.alias("subject"), F.col(value).cast("double").alias("value")))

    own = F.array_compact(F.array(when(F.col("overall_rpe") >= 9, "high_effort", "overall_rpe"), when((F.col("sleep_quality") != 0) & (F.col("sleep_quality") <= 2), "poor_sleep", "sleep_quality"), when(F.col("stress_level") >= 4, "high_stress", "stress_level")))
    daily = recent.select("athlete_id", F.explode(own).alias("w")).select("athlete_id", "w.*")
    stats = entries.join(recent.select("log_id", "athlete_id"), "log_id").where("rpe IS NOT NULL OR make_rate IS NOT NULL")
    so_far = Window.partitionBy("athlete_id", "exercise").orderBy("log_id", "rpe_deviation", "make_rate").rowsBetween(Window.unboundedPreceding, 0)
    stats = stats.select("athlete_id", "exercise", F.struct(*[F.count(F.lit(1)).over(so_far).alias("n"), *[f(c).over(so_far).alias(x) for x, f, c in (("d", F.avg, "rpe_deviation"), ("m", F.avg, "make_rate"), ("nd", F.count, "rpe_deviation"), ("nm", F.count, "make_rate"))]]).alias("s"))
    stats = stats.groupBy("athlete_id", "exercise").agg(F.max("s").alias("s")).select("athlete_id", "exercise", "s.*")
    stats = stats.where("nd >= 2 OR nm >= 2")
    found = F.array_compact(F.array(
        F.when((F.col("nd") >= 2) & (F.col("d") > 1.5), F.struct(F.lit("effort_above_target").alias("kind"), F.col("exercise").alias("subject"), round_even(F.col("d"), 1).alias("value"))),
        F.when((F.col("nm") >= 2) & (F.col("m") < 0.7), F.struct(F.lit("low_make_rate").alias("kind"), F.col("exercise").alias("subject"), round_even(F.col("m") * 100).alias("value"))),
    ))
    return daily.unionByName(stats.select("athlete_id", F.explode(found).alias("w")).select("athlete_id", "w.*"))


def retrieval_quality(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Per query: results, sources, similarity range, and whether expected topics and types were hit.

    hits: query, source, similarity, topics, chunk_type.  cases: query, expected_topics, expected_types.
    """
    per = hits.groupBy("query").agg(
        F.count(F.lit(1)).alias("results"), F.countDistinct("source").alias("sources"), F.bround(F.min("similarity"), 3).alias("low"), F.bround(F.max("similarity"), 3).alias("high"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"), F.array_sort(F.collect_set("chunk_type")).alias("types"),
    )
    out = cases.join(per, "query", "left").na.fill(0, ["results", "sources"])
    hit = lambda want, got: F.coalesce(F.size(F.array_intersect(want, got)) > 0, F.lit(False))
    return out.withColumns({"topic_hit": hit("expected_topics", "topics"), "type_hit": hit("expected_types", "types")})
