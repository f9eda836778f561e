"""Numeric functions: loads, ratios, bounded parsing, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.compat import nullif_zero, present

#: Seconds of a set, default rest, shortest session, token prices per token.
SECONDS_PER_SET, DEFAULT_REST_SECONDS, MIN_SESSION_MINUTES = 30, 90, 30
PRICE_IN, PRICE_OUT = 3 / 1_000_000, 15 / 1_000_000


def round_kg(weight: Column, increment: float = 0.5) -> Column:
    """To the nearest increment, half to even, then one decimal."""
    return F.bround(F.rint(weight / F.lit(increment)) * F.lit(increment), 1)


def percent_of(maximum: Column, pct: Column) -> Column:
    return maximum * pct / F.lit(100)


def resolved_weight(maximum: Column, pct: Column) -> Column:
    """The load of a percentage of a maximum; null where either is absent or 0."""
    return F.when(present(maximum) & present(pct), round_kg(percent_of(maximum, pct)))


def scaled_pct(v: Column, lo: Column, hi: Column) -> Column:
    """Place of v between lo and hi in whole percent, within 0 and 100."""
    place = F.bround((v - lo) / (hi - lo) * 100, 0)
    return F.when(place.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), place))).cast("int")


def progress(current: Column, target: Column) -> tuple[Column, Column]:
    """Gap to the target and percent reached, at most 100; null without a target."""
    c, t = F.coalesce(current, F.lit(0.0)), nullif_zero(target)
    return F.bround(t - c, 1), F.when(t.isNotNull(), F.least(F.lit(100.0), F.bround(c / t * 100, 0))).cast("int")


def ratio_status(value: Column, target: Column, tolerance: float = 0.04) -> Column:
    """below / on_target / above a target, with a tolerance either way."""
    return F.when(value < target - tolerance, "below").when(value > target + tolerance, "above").otherwise("on_target")


def deviation(actual: Column, planned: Column, digits: int) -> Column:
    """Rounded difference; null where either side is null or 0."""
    return F.when(present(actual) & present(planned), F.bround(actual - planned, digits))


def bounded_float(text: Column, limit: float = 10000.0) -> Column:
    """A finite number of magnitude below the limit, else null."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit), x)


def bounded_int(text: Column, lo: int | None = None, hi: int | None = None) -> Column:
    """A whole number of magnitude below 2e9 within [lo, hi], else null."""
    x = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))
    good = F.abs(x) < 2_000_000_000
    good = good & (x >= lo) if lo is not None else good
    good = good & (x <= hi) if hi is not None else good
    return F.when(good, x)


def representative_reps(spec: Column) -> Column:
    """'3' is 3, '3,2,1' its mean, '8-10' its middle; null for anything else."""
    s = F.trim(spec)
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    ends = F.transform(F.split(s, "-"), lambda p: F.trim(p).try_cast("double"))
    return (
        F.when(s.contains(","), total / F.size(parts))
        .when(s.contains("-") & (F.size(ends) == 2), (F.element_at(ends, 1) + F.element_at(ends, 2)) / 2)
        .otherwise(s.try_cast("double"))
    )


def strict_int(text: Column) -> Column:
    """'75' is 75, '75.0' too; 2.9, booleans and words are null."""
    x = text.try_cast("double")
    return F.when(x == F.floor(x), x.try_cast("int"))


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.lit(PRICE_IN) + tokens_out * F.lit(PRICE_OUT)


def session_seconds(sets: Column, rest: Column) -> Column:
    """Work and rest of an exercise; an absent or zero rest takes the default."""
    return F.coalesce(sets, F.lit(0)) * (F.lit(SECONDS_PER_SET) + F.coalesce(nullif_zero(rest), F.lit(DEFAULT_REST_SECONDS)))


def remaining(budget: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), budget - used)


def projected_max(current: Column, target: Column, phase: Column, goal_date: Column, as_of: Column) -> Column:
    """In realization before a future date the larger of maximum and target, else the maximum."""
    ahead = (phase == "realization") & (goal_date >= as_of) & target.isNotNull()
    return F.when(ahead, F.greatest(F.coalesce(current, F.lit(0.0)), target)).otherwise(current)


def dual_reps(sets: Column, reps: Column) -> Column:
    """Total reps of an array that lists each set, or holds one number for all sets; 0 for an empty array."""
    return F.when(F.size(reps) == 1, sets * reps[0]).otherwise(F.aggregate(reps, F.lit(0).cast("long"), lambda a, x: a + x))


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers; null for an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def adherence(done: Column, planned: Column) -> Column:
    """Percent done; 0 where nothing was planned."""
    return F.coalesce(F.try_divide(done * F.lit(100.0), planned), F.lit(0.0))
