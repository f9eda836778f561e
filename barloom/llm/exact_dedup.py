"""Operator 7: exact deduplication with skew-safe combining.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Three stages, each grouping by digest *and* the full normalised text:

1. local: every task folds the copies in its own partition, as one salt holds a
   whole partition (map-side combine: a text leaves a task once),
2. salted: what tasks of one salt found meets, so a text that a third of all rows
   share is spread over ``salts`` tasks,
3. global: the at most ``salts`` salt winners of a text meet.

Stage 3 also finds how many contents a digest has.  As that is proven to be one,
members (narrow rows of doc_id, digest and a salt of their own, written once)
learn their group by digest and salt alone, and no text is moved a third time;
two contents of one digest stop the query instead of mixing groups.

Ties: of equal texts the row with the largest doc_id stays; rows that repeat a
doc_id and text are all kept if it is the largest.  A null doc_id sorts below all
others.  An empty table gives an empty result.  Further columns, whatever their
names, pass through survivors() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import partitions, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most 63: the salts of a digest are the bits of one long.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("__norm"))
    rows = rows.withColumn("__digest", F.unhex(F.sha2("__norm", 256)))
    # a salt for each partition: Spark's map-side aggregate folds a partition's copies before they are salted
    local = rows.withColumn("__task", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("__digest", "__norm", "__task").agg(F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    # one exchange by digest serves both groupings
    contents = (
        salted.repartition(partitions(docs.sparkSession), "__digest")
        .groupBy("__digest", "__norm")
        .agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    )
    whole = contents.groupBy(F.col("__digest").alias("__d")).agg(F.max("__keep").alias("keep_id"), F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__contents"))
    whole = whole.where(F.when(F.col("__contents") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("two contents of one SHA-256")).cast("boolean")))

    # members are written with their salts, so that both of their uses see the same
    members = staged(rows.select("doc_id", "__digest", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("__salt")), "exact-members")
    present = members.groupBy(F.col("__digest").alias("__p")).agg(F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"))
    spread = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col("__salts"), s) == 1)
    whole = whole.join(present, F.col("__d") == F.col("__p")).select("keep_id", "group_size", "__d", F.explode(spread).alias("__s"))
    found = members.join(whole, (F.col("__digest") == F.col("__d")) & (F.col("__salt") == F.col("__s")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: found by doc_id and content, as an id may repeat with other texts."""
    kept = groups(docs, text, doc_id, salts).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    same = docs[f"`{doc_id}`"].cast("long").eqNullSafe(kept["id"]) & (digest_of(docs[f"`{text}`"]) == kept["digest"])
    return docs.join(kept, same, "left_semi")
