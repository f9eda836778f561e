"""Incoming records: validation with a side output, checked links, normalisation, budgets and keyed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import all_of, nullif_blank, nullif_zero
from barloom.functions.collections import bounded_ints
from barloom.functions.dates import clamped_log_date
from barloom.functions.numbers import bounded_float, bounded_int, deviation, token_cost
from barloom.functions.text import lift_ref
from barloom.operators.merge import one_a_key

# Words for a goal and the goal they stand for; vocabularies of a profile.
GOAL_WORDS = {
    "peaking": "competition_prep",
    "competition": "competition_prep",
    "strength": "general_strength",
    "technique": "technique_focus",
    "conditioning": "work_capacity",
}
MOST_REPS = 999
LEVELS = ["beginner", "intermediate", "advanced", "elite"]


def checked(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the rules they break (an unknown answer breaks one)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def linked(df: DataFrame, raw: str, offered: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Adds ``id_column``: the id written in ``raw`` if it is all digits and was offered for the row's keys, else null."""
    number = F.when(F.trim(F.col(raw)).rlike(r"^\d+$"), F.trim(F.col(raw)).try_cast("bigint"))
    good = offered.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(id_column).cast("long").alias("__id")).distinct()
    same = F.col("__want") == F.col("__id")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    out = df.withColumn("__want", number).join(good, same, "left")
    return out.select(*df.columns, F.col("__id").alias(id_column))


def program_templates(df: DataFrame) -> DataFrame:
    """Template rows with a level, a known goal, dimensions of 1 or more and the identity of their structure (JSON text)."""
    goal = F.lower(F.trim("goal"))
    known = F.create_map(*[F.lit(x) for kv in GOAL_WORDS.items() for x in kv])
    whole = lambda c: F.when(F.col(c).try_cast("int") >= 1, F.col(c).try_cast("int"))
    rows = df.withColumns({
        "name": F.substring("name", 1, 300), "goal": F.coalesce(known[goal], goal), "athlete_level": F.when(F.lower("athlete_level").isin(LEVELS), F.lower("athlete_level")).otherwise("any"),
        "duration_weeks": whole("duration_weeks"), "sessions_per_week": whole("sessions_per_week"), "structure_md5": F.md5(F.to_json(F.try_parse_json("structure"))),
    })
    return rows.where(F.col("duration_weeks").isNotNull() & F.col("sessions_per_week").isNotNull())


def logged_entries(entries: DataFrame, planned: DataFrame) -> DataFrame:
    """Entries with deviations from the plan; a link to a row of another session is dropped.

    entries: log_id, session_id, planned_id, weight_kg, rpe.  planned: planned_id, session_id, planned_kg, rpe_target.
    """
    p = planned.select(F.col("planned_id").alias("__p"), F.col("session_id").alias("__s"), "planned_kg", "rpe_target")
    out = entries.join(p, (F.col("planned_id") == F.col("__p")) & (F.col("session_id") == F.col("__s")), "left").withColumn("planned_id", F.col("__p"))
    return out.drop("__p", "__s").withColumns({"weight_deviation_kg": deviation(F.col("weight_kg"), F.col("planned_kg"), 2), "rpe_deviation": deviation(F.col("rpe"), F.col("rpe_target"), 1)})


def log_values(forms: DataFrame, today: Column) -> DataFrame:
    """Fields of a session log from a form's texts, beside log_id and position: what is no number in range is null, a blank note too.

    forms: log_id, position, log_date, overall_rpe, duration, bodyweight, sleep_quality, stress_level, notes.
    """
    c = F.col
    return forms.select(
        "log_id", "position", clamped_log_date(c("log_date"), today).alias("log_date"), bounded_float(c("overall_rpe")).alias("overall_rpe"), bounded_int(c("duration"), 1).cast("int").alias("session_duration_minutes"),
        bounded_float(c("bodyweight")).alias("bodyweight_kg"), bounded_int(c("sleep_quality"), 1, 5).cast("int").alias("sleep_quality"), bounded_int(c("stress_level"), 1, 5).cast("int").alias("stress_level"), nullif_blank(c("notes")).alias("athlete_notes"),
    )


def entry_values(forms: DataFrame) -> DataFrame:
    """Fields of an exercise entry from a form's texts, beside id, log_id and position; sets default to the number of rep entries, or 1.

    forms: id, log_id, position, weight_kg, rpe, make_rate (percent), reps_per_set, sets_completed, technical_notes.
    """
    c = F.col
    reps = F.nullif(bounded_ints(c("reps_per_set"), 1, MOST_REPS), F.array().cast("array<int>"))
    return forms.select(
        "id", "log_id", "position", bounded_float(c("weight_kg")).alias("weight_kg"), bounded_float(c("rpe")).alias("rpe"), (bounded_float(c("make_rate")) / 100).alias("make_rate"), reps.alias("reps_per_set"),
        F.coalesce(nullif_zero(bounded_int(c("sets_completed"))), F.array_size(reps), F.lit(1)).cast("int").alias("sets_completed"), nullif_blank(c("technical_notes")).alias("technical_notes"),
    )


def overwritten(table: DataFrame, values: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """The table with the columns of ``values`` in the rows that agree in all keys (of the table -> of the values); of several the last position."""
    last = one_a_key(values, list(keys.values()), ["position"])
    fields = [c for c in values.columns if c not in (*keys.values(), "position")]
    new = last.select(*[F.col(v).alias(f"__k_{k}") for k, v in keys.items()], *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    rows = table.join(new, all_of(*[F.col(k) == F.col(f"__k_{k}") for k in keys]), "left")
    return rows.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def updated_logs(logs: DataFrame, forms: DataFrame, today: Column) -> DataFrame:
    """Session logs (id, ...) after forms of some: all fields of a form are stored, blank ones as null."""
    return overwritten(logs, log_values(forms, today), {"id": "log_id"})


def updated_entries(entries: DataFrame, forms: DataFrame, planned: DataFrame) -> DataFrame:
    """Exercise entries after forms of some, with deviations from what the entry was prescribed and from its plan's effort.

    A form counts only for an entry of its own log.  A weight left blank is stored as 0 and has no deviation.
    entries: id, log_id, planned_id, prescribed_weight_kg, weight_deviation_kg, rpe_deviation and the fields of entry_values().
    planned: planned_id, rpe_target.
    """
    own = entries.select(F.col("id").alias("__e"), F.col("log_id").alias("__l"), "planned_id", "prescribed_weight_kg")
    values = entry_values(forms).join(own, (F.col("id") == F.col("__e")) & (F.col("log_id") == F.col("__l")))
    values = values.join(planned.select(F.col("planned_id").alias("__p"), "rpe_target"), F.col("planned_id") == F.col("__p"), "left")
    values = values.withColumns({"weight_deviation_kg": deviation(F.col("weight_kg"), F.col("prescribed_weight_kg"), 2), "rpe_deviation": deviation(F.col("rpe"), F.col("rpe_target"), 1), "weight_kg": F.coalesce("weight_kg", F.lit(0.0))})
    return overwritten(entries, values.drop("__e", "__l", "__p", "planned_id", "prescribed_weight_kg", "rpe_target"), {"id": "id", "log_id": "log_id"})


def token_totals(log: DataFrame, key: str) -> DataFrame:
    """Tokens and cost by key."""
    tin, tout = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    return log.groupBy(key).agg(F.sum(tin).alias("input_tokens"), F.sum(tout).alias("output_tokens"), F.sum(token_cost(tin, tout)).alias("cost"))


def within_budget(log: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, limit: Column | float) -> DataFrame:
    """Rows that were begun before the running cost of their key reached the limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return log.withColumn("spent_before", spent).where(F.col("spent_before") < limit)


def keyed_maxima(maxes: DataFrame, keys: Sequence[str], known: Mapping[str, str] | None = None) -> DataFrame:
    """Weight by normalised lift; of names that fall together the row with the largest id counts."""
    ref = lift_ref(F.col("exercise_name"), known) if known is not None else lift_ref(F.col("exercise_name"))
    return maxes.groupBy(*keys, ref.alias("lift")).agg(F.max_by("weight_kg", "id").alias("weight_kg"))


def test_day(sessions: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Day of a maximum test: the one after the last."""
    return sessions.groupBy(*keys).agg((F.max(day) + 1).alias("test_day"))


def session_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Done and all sessions, whole percent, and the intensity range of the first session."""
    first = F.min("session_id").over(Window.partitionBy(*keys))
    marked = rows.withColumn("__first", first == F.col("session_id"))
    pct = F.when(F.col("__first"), F.col("intensity_pct"))
    out = marked.groupBy(*keys).agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(F.col("done"), F.col("session_id"))).alias("done"), F.min(pct).alias("low"), F.max(pct).alias("high"))
    return out.withColumn("done_pct", F.coalesce(F.bround(F.try_divide(F.col("done") * 100.0, F.col("sessions")), 0), F.lit(0.0)).cast("int"))


def defaulted(df: DataFrame, **defaults: object) -> DataFrame:
    """Defaults for null, 0 and ''."""
    types = dict(df.dtypes)
    blank = lambda c: nullif_blank(F.col(c)) if types[c] == "string" else F.nullif(F.col(c), F.lit(0))
    return df.withColumns({c: F.coalesce(blank(c), F.lit(v)) for c, v in defaults.items()})
