"""Exports: training log and programmes as spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.compat import nullif_blank, nullif_zero
from barloom.functions.text import csv_safe, safe_filename

# The columns of both files in order, and where their values come from.
TRAINING_LOG = {
    "date": "log_date", "program": "program_name", "week": "week_number", "day": "day_number", "session": "session_label",
    "session_rpe": "session_rpe", "duration_min": "duration_min", "bodyweight_kg": "bodyweight_kg", "sleep_quality": "sleep_quality", "stress_level": "stress_level",
    "session_notes": "session_notes", "exercise": "exercise_name", "sets": "sets_completed", "reps": "reps_per_set", "weight_kg": "weight_kg",
    "prescribed_kg": "prescribed_weight_kg", "weight_deviation_kg": "weight_deviation_kg", "exercise_rpe": "exercise_rpe", "rpe_deviation": "rpe_deviation",
    "make_rate_pct": "make_rate", "technical_notes": "technical_notes",
}
PROGRAM = {
    "week": "week_number", "day": "day_number", "session": "session_label", "focus_area": "focus_area", "session_duration_min": "session_duration_min",
    "order": "exercise_order", "exercise": "exercise_name", "sets": "sets", "reps": "reps", "intensity_pct": "intensity_pct", "intensity_reference": "intensity_reference",
    "weight_kg": "absolute_weight_kg", "rpe_target": "rpe_target", "rest_seconds": "rest_seconds", "backoff_sets": "backoff_sets",
    "backoff_intensity_pct": "backoff_intensity_pct", "is_max_attempt": "is_max_attempt", "notes": "notes",
}
PROGRAM_HEAD = {"program": "name", "phase": "phase", "status": "status", "start_date": "start_date", "duration_weeks": "duration_weeks", "sessions_per_week": "sessions_per_week"}
LINE_END = "\r\n"


def training_log(rows: DataFrame) -> DataFrame:
    """The 21 columns of the training log; what is absent is null, which a CSV sink writes as nothing."""
    types = dict(rows.dtypes)
    special = {"reps_per_set": F.when(F.size("reps_per_set") > 0, F.array_join(F.col("reps_per_set").cast("array<string>"), ",")), "make_rate": F.bround(F.col("make_rate").cast("double") * 100, 0).cast("int")}

    def cell(source: str) -> Column:
        if source in special:
            return special[source]
        return csv_safe(nullif_blank(F.col(source))) if types[source] == "string" else F.col(source)

    return rows.select(*[cell(source).alias(name) for name, source in TRAINING_LOG.items()])


def csv_field(value: Column) -> Column:
    """A field of a line: quoted if it holds a comma, a quote or a line end; null is empty."""
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_field(v) for v in values])


def program_files(programs: DataFrame, rows: DataFrame) -> DataFrame:
    """program_id, file_name, content: one CSV file a programme, with a block of its own data, a blank line and 18 columns.

    A file holds one programme's exercises, so it is small however many programmes there are.  rows have program_id and
    the columns of PROGRAM's sources; they are ordered by week, day and order.
    """
    types = dict(rows.dtypes)

    def cell(source: str) -> Column:
        c = F.col(source)
        if source == "is_max_attempt":
            return F.when(c, "yes")
        if source == "backoff_sets":
            return nullif_zero(c).cast("string")
        return csv_safe(nullif_blank(c)) if types[source] == "string" else c.cast("string")

    line = csv_line(*[cell(s) for s in PROGRAM.values()])
    body = rows.select("program_id", F.struct("week_number", "day_number", "exercise_order", line.alias("line")).alias("at"))
    body = body.groupBy(F.col("program_id").alias("__p")).agg(F.array_sort(F.collect_list("at")).alias("__at"))
    own = dict(programs.dtypes)
    head = [csv_line(F.lit(label), csv_safe(F.col(c)) if own[c] == "string" and label == "program" else F.col(c).cast("string")) for label, c in PROGRAM_HEAD.items()]
    lines = F.concat(F.array(*head, F.lit(""), F.lit(",".join(PROGRAM))), F.coalesce(F.transform("__at", lambda x: x["line"]), F.array().cast("array<string>")), F.array(F.lit("")))
    name = F.coalesce(nullif_blank(F.trim(safe_filename(F.col("name")))), F.lit("program"))
    out = programs.join(body, F.col("program_id") == F.col("__p"), "left")
    return out.select("program_id", F.concat(name, F.lit(".csv")).alias("file_name"), F.array_join(lines, LINE_END).alias("content"))
