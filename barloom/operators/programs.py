"""Writes of programmes, goals, maxima and accounts, for all athletes at once: tables in, new state out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import nullif_blank
from barloom.functions.numbers import bounded_float, bounded_int, progress, token_cost
from barloom.operators.merge import activated, deleted, insert_ignore, marked, unlinked, upsert
from barloom.operators.records import checked
from barloom.operators.relational import keep_first, latest_by
from barloom.operators.store import Transaction

# Defaults of a percentage scheme and of a profile, labels of goals.
SCHEME_DEFAULTS = {"scheme_name": "Unknown", "phase": "accumulation", "week_number": 1, "day_number": 1, "exercise_order": 1, "intensity_reference": "competition_lift"}
PROFILE_DEFAULTS = {"sessions_per_week": 4, "session_duration_minutes": 90, "lift_emphasis": "balanced", "competition_experience": "none", "timezone": "UTC"}
GOAL_LABELS = {"general_strength": "General Strength", "competition_prep": "Competition Prep", "technique_focus": "Technique Focus"}


def program_tables(plans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Programmes, sessions and exercises of generated plans; children are known by their place, from 0.

    plans: program_id, ..., sessions: array<struct<..., exercises: array<struct<...>>>>.
    """
    sessions = plans.select("program_id", F.posexplode("sessions").alias("session_no", "s")).select("program_id", "session_no", "s.*")
    exercises = sessions.select("program_id", "session_no", F.posexplode("exercises").alias("exercise_no", "e"))
    return plans.drop("sessions"), sessions.drop("exercises"), exercises.select("program_id", "session_no", "exercise_no", "e.*")


def create_programs(tx: Transaction, plans: DataFrame) -> DataFrame:
    """Insert generated plans (see program_tables) with their sessions and exercises: all three tables, or none.

    The plans are made once, whatever they cost; gives them as they were made.
    """
    plans = tx.staged("plans", plans)
    for name, rows in zip(("programs", "sessions", "exercises"), program_tables(plans)):
        tx.append(name, rows)
    return plans


def activate_programs(tx: Transaction, chosen: DataFrame) -> None:
    """Drafts among ``chosen`` (program_id) become active, and their athletes' other active programmes superseded."""
    rows = tx.read("programs").join(chosen.select(F.col("program_id").alias("__c")).distinct(), F.col("program_id") == F.col("__c"), "left")
    tx.overwrite("programs", activated(rows, F.col("__c").isNotNull()).drop("__c"))


def delete_programs(tx: Transaction, gone: DataFrame, many: bool = False) -> None:
    """Delete programmes (program_id, athlete_id: only an athlete's own) with sessions, exercises and generation log.

    Logs and their entries stay, without the session or planned exercise that went.  sessions have a session_id, exercises
    an exercise_row_id; logs refer to the first, entries to the second.

    many: what goes is a share of the tables, so its ids are shuffled; else Spark may broadcast them, going by the size of
    their compressed files.
    """
    def split(name: str, lost: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
        ids = tx.split(name, marked(tx.read(name), lost, keys, "__lost"), "__lost", key)
        return ids.hint("shuffle_merge") if many else ids

    gone = gone.hint("shuffle_merge") if many else gone
    own = split("programs", gone, ["program_id", "athlete_id"], "program_id")
    lost, lost_rows = split("sessions", own, ["program_id"], "session_id"), split("exercises", own, ["program_id"], "exercise_row_id")
    tx.overwrite("generations", deleted(tx.read("generations"), own, "program_id"))
    tx.overwrite("logs", unlinked(tx.read("logs"), lost, "session_id"))
    tx.overwrite("entries", unlinked(tx.read("entries"), lost_rows, "exercise_row_id"))


def audit_rows(log: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, error: Column) -> DataFrame:
    """Generations with their attempt number within the key, cost, status and, where they failed, the error."""
    attempt = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cost = token_cost(F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)))
    return log.withColumns({"attempt": attempt, "cost_usd": cost, "status": F.when(failed, "failed").otherwise("ok"), "error": F.when(failed, error)})


def abandoned(programs: DataFrame, chosen: Column) -> DataFrame:
    return programs.withColumn("status", F.when(F.coalesce(chosen, F.lit(False)), "abandoned").otherwise(F.col("status")))


def completed(programs: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """Programmes with an outcome (program_id, outcome) are completed on the day; the outcome stays with them as JSON."""
    out = programs.join(outcomes.select(F.col("program_id").alias("__p"), F.to_json("outcome").alias("__o")), F.col("program_id") == F.col("__p"), "left")
    done = F.col("__p").isNotNull()
    old_end = F.col("end_date") if "end_date" in programs.columns else F.lit(None).cast("date")
    return out.withColumns({"status": F.when(done, "completed").otherwise(F.col("status")), "end_date": F.when(done, today).otherwise(old_end), "outcome_summary": F.col("__o")}).drop("__p", "__o")


def valid_inserts(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows refused with the rules they break): a bad row costs no other, repeats of a key are ignored."""
    good, bad = checked(rows, rules)
    return insert_ignore(table, good, keys, order), bad


def scheme_rows(rows: DataFrame) -> DataFrame:
    """Rows of percentage schemes with defaults for what is absent; sets, reps and percentage have to be there."""
    given = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in SCHEME_DEFAULTS.items()}
    return rows.withColumns(given).where("sets IS NOT NULL AND reps IS NOT NULL AND intensity_pct IS NOT NULL")


def schemes_for(schemes: DataFrame, exercises: DataFrame, phase: str, family: str) -> DataFrame:
    """Prescriptions of a phase for a movement family, in order of week, day and place."""
    own = exercises.where(F.col("movement_family") == family).select(F.col("id").alias("__e"))
    rows = schemes.where(F.col("phase") == phase).join(own, F.col("exercise_id") == F.col("__e"), "left_semi")
    return rows.orderBy("week_number", "day_number", "exercise_order")


def maxes_by_name(maxes: DataFrame, pairs: DataFrame, exercises: DataFrame, today: Column) -> DataFrame:
    """Current maxima after a list of (athlete_id, position, name, weight_kg); unknown names are left out, later rows win.

    maxes: athlete_id, exercise_id, weight_kg, date_achieved.  exercises: id, name.
    """
    ids = exercises.select(F.col("name").alias("__name"), F.col("id").alias("exercise_id"))
    rows = latest_by(pairs.join(ids, F.col("name") == F.col("__name")), ["athlete_id", "exercise_id"], "position", "weight_kg")
    return upsert(maxes, rows.withColumn("date_achieved", today), ["athlete_id", "exercise_id"])


def goals_upserted(goals: DataFrame, changes: DataFrame) -> DataFrame:
    """Goals after one change an athlete: the active goal of highest priority takes it, else a new active goal is added.

    goals: id, athlete_id, is_active, priority and the fields of changes (athlete_id, ...).  New goals have no id yet.
    """
    fields = [c for c in changes.columns if c != "athlete_id"]
    target = keep_first(goals.where("is_active"), ["athlete_id"], F.desc("priority"), F.desc("id")).select(F.col("id").alias("__target"), F.col("athlete_id").alias("__a"))
    new = changes.select(F.col("athlete_id").alias("__who"), *[F.col(c).alias(f"__{c}") for c in fields])
    known = target.join(new, F.col("__a") == F.col("__who")).drop("__a", "__who").withColumn("__hit", F.lit(True))
    hit = goals.join(known, F.col("id") == F.col("__target"), "left")
    kept = hit.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in goals.columns])
    added = changes.join(target, F.col("athlete_id") == F.col("__a"), "left_anti").withColumns({"is_active": F.lit(True), "priority": F.lit(1)})
    return kept.unionByName(added, allowMissingColumns=True)


def goal_progress(goals: DataFrame, maxes: DataFrame, today: Column) -> DataFrame:
    """One row an athlete with an active goal: the goal, days to its date, and gap and percent of each target.

    goals: id, athlete_id, is_active, priority, goal, competition_date, target_snatch_kg, target_cj_kg.
    maxes: athlete_id, snatch, cj (see conditional_pivot).
    """
    top = keep_first(goals.where("is_active"), ["athlete_id"], F.desc("priority"), F.desc("id"))
    rows = top.join(maxes.select(F.col("athlete_id").alias("__a"), "snatch", "cj"), F.col("athlete_id") == F.col("__a"), "left")
    labels = F.create_map(*[F.lit(x) for kv in GOAL_LABELS.items() for x in kv])
    bars = []
    for lift in ("snatch", "cj"):
        now, target = F.col(lift), F.col(f"target_{lift}_kg")
        there = now.isNotNull() & F.coalesce(target != 0, F.lit(False))
        bars += [F.when(there, x).alias(f"{lift}_{name}") for name, x in zip(("gap", "pct"), progress(now, target))]
    label = F.coalesce(F.try_element_at(labels, F.col("goal")), F.initcap(F.replace("goal", F.lit("_"), F.lit(" "))))
    has = F.col("target_snatch_kg").isNotNull() | F.col("target_cj_kg").isNotNull()
    return rows.select("athlete_id", "goal", label.alias("goal_label"), F.datediff("competition_date", today).alias("days_to_comp"), *bars, has.alias("has_targets"))


def renamed(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users after changes (id, username), changes refused): a name that another has, or that a lower id asks for, is taken."""
    want = changes.select(F.col("id").alias("__id"), F.col("username").alias("__name"))
    first = keep_first(want, ["__name"], F.col("__id"))
    held = users.select(F.col("id").alias("__owner"), F.col("username").alias("__held"))
    free = first.join(held, (F.col("__name") == F.col("__held")) & (F.col("__id") != F.col("__owner")), "left_anti")
    after = users.join(free, F.col("id") == F.col("__id"), "left").withColumn("username", F.coalesce("__name", "username")).drop("__id", "__name")
    return after, changes.join(free, F.col("id") == F.col("__id"), "left_anti")


def profiles(rows: DataFrame) -> DataFrame:
    """Profile fields as they are stored: blanks are null, numbers bounded, defaults for what is absent or out of range."""
    text, number = lambda c: nullif_blank(F.col(c)), lambda c: bounded_float(F.col(c).cast("string"))
    whole = lambda c, lo, hi: F.coalesce(bounded_int(F.col(c).cast("string"), lo, hi), F.lit(PROFILE_DEFAULTS[c]))
    made = {c: text(c) for c in ("email", "weight_class", "injuries", "notes") if c in rows.columns}
    made |= {c: number(c) for c in ("bodyweight_kg", "height_cm", "training_age_years") if c in rows.columns}
    made |= {c: whole(c, 1, hi) for c, hi in (("sessions_per_week", 14), ("session_duration_minutes", None)) if c in rows.columns}
    made |= {c: F.coalesce(text(c), F.lit(PROFILE_DEFAULTS[c])) for c in ("lift_emphasis", "competition_experience", "timezone") if c in rows.columns}
    return rows.withColumns(made)


def parents_filled(table: DataFrame, names: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The table with the ids of parents given by name (name, parent_name) where it has none; a filled parent stays."""
    ids = names.join(table.select(F.col("name").alias("__p"), F.col("id").alias("__id")), F.col("parent_name") == F.col("__p")).select(F.col("name").alias("__n"), "__id")
    return table.join(ids, F.col("name") == F.col("__n"), "left").withColumn(parent, F.coalesce(F.col(parent), F.col("__id"))).drop("__n", "__id")


def with_default(table: DataFrame, column: str, value: object, chosen: Column | None = None, instead: object = None) -> DataFrame:
    """The table with a new column of one value, and another for chosen rows."""
    out = F.lit(value)
    return table.withColumn(column, out if chosen is None else F.when(F.coalesce(chosen, F.lit(False)), F.lit(instead)).otherwise(out))
