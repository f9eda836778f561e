"""Sinks over Parquet: insert-ignore, upserts with a policy by column, deletes with cascade, ledgers, CSV.

A merge returns the new state of the table; operators/store.py puts it in the place of the old, with other tables' changes if
there are any.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.compat import all_of, nullif_blank
from barloom.functions.text import csv_safe

Policy = Callable[[Column, Column], Column]


def newest(old: Column, new: Column) -> Column:
    return new


def curated(old: Column, new: Column) -> Column:
    """Keep what is there unless it is null or blank."""
    return F.coalesce(nullif_blank(old), new)


def curated_list(old: Column, new: Column) -> Column:
    """Keep a list that is there unless it is empty."""
    return F.when(F.coalesce(F.size(old), F.lit(0)) > 0, old).otherwise(new)


def fill(old: Column, new: Column) -> Column:
    """The new value, or the old one where the new is null."""
    return F.coalesce(new, old)


def complete(keys: Sequence[str]) -> Column:
    return all_of(*[F.col(k).isNotNull() for k in keys])


def one_a_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of changes with one key the last in the given order; rows whose key has a null stay all.  Combines before it shuffles.

    Where the order leaves a tie, the largest of the other columns decides (maps aside, which have no order): one result, wherever rows lie.
    """
    whole = complete(keys)
    rest = [c for c in changes.columns if c not in keys]
    ordered = [c for c in rest if "map<" not in changes.schema[c].dataType.simpleString()]
    place = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)], *ordered)
    last = changes.where(whole).groupBy(*keys).agg(F.max(place).alias("__r") if ordered == rest else F.max_by(F.struct(*rest), place).alias("__r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in changes.columns]).unionByName(changes.where(~whole))


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], policies: Mapping[str, Policy] | None = None, insert: bool = True, order: Sequence[str | Column] | None = None) -> DataFrame:
    """The table after a merge.  Rows whose key has a null never match: those of ``changes`` are added.

    order: of changes with one key the last in this order is made, as if they came one after the other.  Without it a key that
    ``changes`` has twice fails the query, as it would multiply rows of the table.
    """
    policies = policies or {}
    if order is not None:
        changes = one_a_key(changes, keys, order)
    else:
        whole = complete(keys)
        twice = F.raise_error(F.concat(F.lit(f"changes have a key ({', '.join(keys)}) twice: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
        counted = changes.where(whole).withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        changes = counted.where(F.when(F.col("__times") > 1, twice.cast("boolean")).otherwise(True)).drop("__times").unionByName(changes.where(~whole))
    a, b = table.withColumn("__old", F.lit(True)).alias("a"), changes.withColumn("__new", F.lit(True)).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    out = a.join(b, same, "full_outer" if insert else "left")
    columns = []
    for c in table.columns:
        old = F.col(f"a.{c}")
        if c not in changes.columns:
            columns.append(old.alias(c))
            continue
        new = F.col(f"b.{c}")
        value = F.coalesce(old, new) if c in keys else policies.get(c, newest)(old, new)
        columns.append(F.when(F.col("__new").isNull(), old).when(F.col("__old").isNull(), new).otherwise(value).alias(c))
    return out.select(*columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], null_safe: bool = False) -> DataFrame:
    """The rows that would be added: not in the table, and the first of their key.

    null_safe: null keys are equal to each other; else rows with a null key are always added.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("__rn", F.row_number().over(w))
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    first = first.where((F.col("__rn") == 1) | (F.lit(not null_safe) & some_null)).drop("__rn")
    old = table.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k).eqNullSafe(F.col(f"__{k}")) if null_safe else F.col(k) == F.col(f"__{k}"))
    return first.join(old, same, "left_anti")


def dedup_keep_lowest(table: DataFrame, keys: Sequence[str], id_column: str, null_safe: bool) -> DataFrame:
    """Keep the lowest id of each key; without null_safe, rows with a null key are all kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(id_column))
    out = table.withColumn("__rn", rank)
    exempt = F.lit(False)
    if not null_safe:
        for k in keys:
            exempt = exempt | F.col(k).isNull()
    return out.where((F.col("__rn") == 1) | exempt).drop("__rn")


def repointed(parents: DataFrame, children: DataFrame, key: str, parent_id: str, child_ref: str) -> tuple[DataFrame, DataFrame]:
    """Merge parents that share a key into the one of lowest id: (parents kept, children that point to those)."""
    keeper = F.first(parent_id).over(Window.partitionBy(key).orderBy(parent_id))
    kept = parents.withColumn("__keep", F.when(F.col(key).isNull(), F.col(parent_id)).otherwise(keeper))
    to = kept.select(F.col(parent_id).alias("__from"), F.col("__keep").alias("__to"))
    moved = children.join(to, F.col(child_ref) == F.col("__from"), "left").withColumn(child_ref, F.coalesce("__to", child_ref)).drop("__from", "__to")
    return kept.where(F.col(parent_id) == F.col("__keep")).drop("__keep"), moved


def deleted(table: DataFrame, gone: DataFrame, on: str, gone_key: str | None = None) -> DataFrame:
    """The table without the rows whose key is in ``gone``."""
    ids = gone.select(F.col(gone_key or on).alias("__gone")).distinct()
    return table.join(ids, F.col(on) == F.col("__gone"), "left_anti")


def marked(table: DataFrame, gone: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """The table with a mark: whether the row agrees with one of ``gone`` in all keys."""
    ids = gone.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn(mark, F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return table.join(ids, same, "left").withColumn(mark, F.col(mark).isNotNull()).drop(*[f"__{k}" for k in keys])


def deleted_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows that agree with one of ``gone`` in all keys."""
    ids = gone.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return table.join(ids, same, "left_anti")


def unlinked(table: DataFrame, gone: DataFrame, on: str, gone_key: str | None = None) -> DataFrame:
    """The table with null for references to rows that are in ``gone``."""
    ids = gone.select(F.col(gone_key or on).alias("__gone")).distinct()
    return table.join(ids, F.col(on) == F.col("__gone"), "left").withColumn(on, F.when(F.col("__gone").isNull(), F.col(on))).drop("__gone")


def cascade(root: DataFrame, root_key: str, levels: Sequence[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Rows that go at each level: (table, reference to the level above, own key)."""
    out, gone, key = [], root, root_key
    for table, ref, own in levels:
        ids = gone.select(F.col(key).alias("__up")).distinct()
        gone, key = table.join(ids, F.col(ref) == F.col("__up"), "left_semi"), own
        out.append(gone)
    return out


def activated(programs: DataFrame, chosen: Column) -> DataFrame:
    """A chosen draft becomes active and supersedes its athlete's other active programmes."""
    start = chosen & (F.col("status") == "draft")
    any_start = F.max(start).over(Window.partitionBy("athlete_id"))
    status = F.when(start, "active").when(any_start & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return programs.withColumn("status", status)


def personal_best(old: Column, new: Column) -> Column:
    return old.isNull() | (new > old)


def promoted_maxes(maxes: DataFrame, entries: DataFrame, keys: Sequence[str] = ("athlete_id", "exercise_id")) -> DataFrame:
    """Maxima after max attempts with a known exercise and a strictly greater weight."""
    tries = entries.where("is_max_attempt AND exercise_id IS NOT NULL").groupBy(*keys).agg(F.max("weight_kg").alias("weight_kg"))
    return upsert(maxes, tries, keys, {"weight_kg": lambda old, new: F.greatest(old, new)})


def latest_state(ledger: DataFrame, run: str = "run_id", at: str = "ts") -> DataFrame:
    """Current row of each run of an append-only ledger, with the seconds since it began."""
    others = [c for c in ledger.columns if c not in (run, at)]
    out = ledger.groupBy(run).agg(F.min(at).alias("started_at"), F.max(at).alias("updated_at"), F.max_by(F.struct(*others), F.struct(at, *others)).alias("__s"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("updated_at")) / 1_000_000
    return out.select(run, "started_at", "updated_at", *[F.col(f"__s.{c}").alias(c) for c in others], seconds.alias("duration_seconds"))


def rolled_back(chunks: DataFrame, log: DataFrame, run_id: Column) -> tuple[DataFrame, DataFrame]:
    """Log without a run, and the chunks that some other run still refers to."""
    rest = log.where(~run_id)
    return rest, chunks.join(rest.select(F.col("chunk_id").alias("__c")).distinct(), F.col("id") == F.col("__c"), "left_semi")


def source_titles(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (title, author, url) with the id of their source and the title it is stored under.

    A known URL decides; else title and author, if that source has no other URL.  A title taken by another URL
    gets the slug of the row's own in brackets, or eight digits of its MD5 where there is none.
    """
    by_url = sources.where("url IS NOT NULL").select(F.col("url").alias("__u"), F.col("id").alias("__by_url"), F.col("title").alias("__t1"))
    by_name = sources.select(F.col("title").alias("__t"), F.col("author").alias("__a"), F.col("id").alias("__by_name"), F.col("url").alias("__url"))
    out = rows.join(by_url, F.col("url") == F.col("__u"), "left").join(by_name, (F.col("title") == F.col("__t")) & F.col("author").eqNullSafe(F.col("__a")), "left")
    taken = F.col("__by_name").isNotNull() & F.col("__url").isNotNull() & F.col("url").isNotNull() & (F.col("url") != F.col("__url"))
    part = F.coalesce(nullif_blank(F.substring_index(F.regexp_replace("url", "/+$", ""), "/", -1)), F.substring(F.md5("url"), 1, 8))
    title = F.coalesce(F.col("__t1"), F.when(taken, F.concat(F.substring("title", 1, 250), F.lit(" ["), part, F.lit("]"))).otherwise(F.col("title")))
    return out.select(*rows.drop("title").columns, F.substring(title, 1, 300).alias("title"), F.coalesce("__by_url", F.when(~taken, F.col("__by_name"))).alias("source_id"))


def write_csv(df: DataFrame, path: str, files: int | None = 1, **options: str) -> None:
    """CSV with a header; text that a spreadsheet would run is quoted, nulls are empty.

    files: 1 for a person's export, which is small; None for as many as there are partitions, each with the header.
    """
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    out = df.select(*safe)
    (out if files is None else out.coalesce(files)).write.options(header="true", emptyValue="", nullValue="", **options).csv(path)
