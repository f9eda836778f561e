"""Relational building blocks: joins, ranked picks, windows and set operations over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import asc


def ranked(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    """Position of each row within its keys; the order has to end in a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, for all keys in one pass."""
    return ranked(df, keys, *order, name="__rank").where(F.col("__rank") <= n).drop("__rank")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return top_per(df, keys, 1, *order)


def latest_by(df: DataFrame, keys: Sequence[str], order: str, *columns: str) -> DataFrame:
    """The given columns of the latest row of each key, by an aggregate that combines before it shuffles."""
    picked = F.max_by(F.struct(*columns), F.struct(order, *columns))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])


def band_join(df: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high", inclusive: bool = False) -> DataFrame:
    """Rows with the band they fall in: [low, high), a null end is open; inclusive bands may match twice at an edge.

    ``bands`` is a rule table of a few rows, so the join is a broadcast loop.
    """
    v = F.col(value)
    below = F.col(high).isNull() | (v <= F.col(high) if inclusive else v < F.col(high))
    return df.join(bands, (v >= F.col(low)) & below, "left")


def nearest(df: DataFrame, value: str, table: DataFrame, key: str) -> DataFrame:
    """df with the key of the small rule table that is nearest to its value; the smaller key wins a tie."""
    keys = table.agg(F.array_sort(F.collect_set(key))).scalar()
    return df.withColumn("__keys", keys).withColumn(key, F.array_min(F.transform("__keys", lambda k: F.struct(F.abs(k - F.col(value)).alias("d"), k.alias("k"))))["k"]).drop("__keys")


def merged_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """Full outer join of two aggregates; the columns ``zero`` are 0 where their side has no row."""
    out = left.join(right, list(keys), "full_outer")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def lookup(df: DataFrame, json_columns: Sequence[str] = (), **keys: object) -> DataFrame:
    """Rows by key values (null is none of them), with JSON text columns as variants."""
    rows = df
    for c, v in keys.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows.withColumns({c: F.try_parse_json(c) for c in json_columns})


def missing_from(df: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def present_in(df: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def any_of(df: DataFrame, column: str, values: DataFrame, of: str) -> DataFrame:
    """Rows whose column is among the values of a table: an array parameter of any length."""
    given = values.select(F.col(of).alias("__of")).distinct()
    return df.join(given, F.col(column) == F.col("__of"), "left_semi")


def same_name(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)


def dictionary_ids(rows: DataFrame, column: str, names: DataFrame, name: str = "name", id_column: str = "id", to: str = "exercise_id") -> DataFrame:
    """Adds the id of a name, found without regard to case; null for unknown names.  Of names that differ in case the smallest id counts."""
    table = names.groupBy(F.lower(name).alias("__k")).agg(F.min(id_column).alias(to))
    return rows.join(table, F.lower(F.col(column)) == F.col("__k"), "left").drop("__k")


def without(df: DataFrame, *columns: str) -> DataFrame:
    """The table without some columns, whether it has them or not: what may go into a snapshot."""
    return df.drop(*columns)


def scalar_of(df: DataFrame, value: Column, *order: Column) -> Column:
    """The value of the first row as a scalar subquery; null if there is none."""
    return df.orderBy(*order).limit(1).select(value.alias("v")).scalar()


def ordered_top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of the whole table in an order of several keys."""
    return df.orderBy(*order).limit(n)


def prefix_per(df: DataFrame, position: str, n: int) -> DataFrame:
    """Rows at the first n positions (from 0) of their sequence; 0 is no limit."""
    return df.where(F.col(position) < n) if n else df


def nested(parents: DataFrame, children: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Each parent with the ordered array of its children; parents without any have an empty one."""
    rest = [c for c in children.columns if c not in keys]
    items = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))
    gathered = children.groupBy(*keys).agg(items.alias(name))
    return parents.join(gathered, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(gathered.schema[name].dataType)))


def first_seen_union(frames: Sequence[DataFrame], key: str, *order: Column) -> DataFrame:
    """Union of ranked results; a key counts for the first frame that has it."""
    parts = [df.withColumn("source_no", F.lit(i)) for i, df in enumerate(frames)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return keep_first(out, [key], F.col("source_no"), *order)


def quota_merge(first: DataFrame, second: DataFrame, key: str, order: str, quota: int, total: int) -> DataFrame:
    """Up to ``quota`` rows of the first, then rows of the second, ``total`` in all, no key twice."""
    lead = first.orderBy(asc(order), asc(key)).limit(quota)
    both = first_seen_union([lead, second], key, F.col(order))
    return both.orderBy("source_no", asc(order), asc(key)).limit(total)


def forward_filled(df: DataFrame, keys: Sequence[str], order: str, source: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(source, ignorenulls=True).over(w))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, before: str, through: str) -> DataFrame:
    """Running totals within the keys: before the row (0 for the first) and through it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prior = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({before: prior, through: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def windows(df: DataFrame, text: str, size: int, step: int) -> DataFrame:
    """window_no and window_text: overlapping pieces of a text; a text no longer than ``size`` is one."""
    length = F.length(F.col(text))
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 1, F.lit(step)))
    out = df.select("*", F.posexplode(starts).alias("window_no", "__at"))
    return out.withColumn("window_text", F.substring(F.col(text), F.col("__at") + 1, F.lit(size))).drop("__at")
