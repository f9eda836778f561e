"""Arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    """Some element in common; false rather than null."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def contains_all(have: Column, need: Column) -> Column:
    return F.coalesce(F.size(F.array_except(need, have)) == 0, F.lit(False))


def union_sorted(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def set_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """What is new, and what is gone."""
    return F.array_except(new, old), F.array_except(old, new)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def first_seen(*arrays: Column, most: int | None = None) -> Column:
    """Concatenation without repeats, first occurrence first, cut to ``most``."""
    out = F.array_distinct(F.concat(*arrays))
    return out if most is None else F.slice(out, 1, most)


def bounded_ints(text: Column, lo: int, hi: int) -> Column:
    """Whole numbers of a comma list, blank entries left out; one that is no number or out of range empties the list."""
    parts = F.transform(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""), lambda p: p.try_cast("int"))
    good = F.forall(parts, lambda x: F.coalesce((x >= lo) & (x <= hi), F.lit(False)))
    return F.when(good, parts).otherwise(F.array().cast("array<int>"))


def total(a: Column) -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def joined(a: Column, sep: str = ",") -> Column:
    return F.array_join(a.cast("array<string>"), sep)


def json_text(doc: Column, path: str) -> Column:
    """A member as text; null if it is absent.  doc is a variant."""
    return F.try_variant_get(doc, path, "string")


def open_or_equal(doc: Column, path: str, value: Column) -> Column:
    """A rule's optional condition: no document, no such member, or that very text."""
    member = json_text(doc, path)
    return doc.isNull() | member.isNull() | (member == value)


def open_or_contains(doc: Column, path: str, value: Column) -> Column:
    """As open_or_equal, for a member that may be a list; a member that is JSON null does not match."""
    absent = doc.isNull() | F.try_variant_get(doc, path, "variant").isNull()
    listed = F.coalesce(F.array_contains(F.try_variant_get(doc, path, "array<string>"), value), F.lit(False))
    return absent | listed | F.coalesce(json_text(doc, path) == value, F.lit(False))


def compares(doc: Column, path: str, value: Column) -> Column:
    """Nested comparisons lte, gte, lt, gt, eq of a member: those present must all hold."""
    out = F.lit(True)
    tests = {"lte": lambda x: value <= x, "gte": lambda x: value >= x, "lt": lambda x: value < x, "gt": lambda x: value > x, "eq": lambda x: value == x}
    for name, test in tests.items():
        bound = F.try_variant_get(doc, f"{path}.{name}", "double")
        out = out & F.coalesce(bound.isNull() | test(bound), F.lit(True))
    return out


def with_defaults(text: Column, schema: str, **defaults: object) -> Column:
    """Typed struct of a JSON text; members that are absent or of another type take their default."""
    parsed = F.from_json(F.coalesce(text, F.lit("{}")), schema)
    names = [part.split()[0] for part in schema.split(", ")]
    return F.struct(*[F.coalesce(parsed[n], F.lit(defaults[n])).alias(n) if n in defaults else parsed[n].alias(n) for n in names])
