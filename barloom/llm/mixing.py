"""Operator 4: mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: target share of all characters over its
actual share.  A document's number of copies is Poisson with that mean, found by
inverting the distribution at a uniform number hashed from seed and doc_id, so
the mix is the same whatever the partitioning and needs no state.  Documents are
exploded by their counts and shuffled globally by a hash of seed, id and copy.

Only DataFrame expressions are used.  Rates above PART are drawn as a sum of
independent Poisson numbers of smaller means, so the inversion never underflows.

Nulls: a null source is a source of its own, a null doc_id hashes as "null", a
null or empty text counts one character so that every source has a size.  Rows
repeated with the same doc_id get the same count each.  Sources with target
weight 0 or missing from ``weights`` give no rows; an empty table gives none.
Further columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import partitions, staged, unused

#: Largest mean inverted in one piece, and the terms that reach probability 1 - 1e-15 there.
PART, TERMS = 8.0, 48
SEED = "mix-1"
#: Default targets: shares of all characters to this power, so small sources are raised.
TEMPERATURE = 0.5
RESERVED = ("copy_no", "rate", "shuffle_key")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson(key: Column, rate: Column) -> Column:
    """A Poisson number with mean ``rate``, a function of ``key`` alone."""
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(PART))).cast("int")
    mean = rate / parts

    def one(i: Column) -> Column:
        u = uniform(F.concat_ws("|", key, i.cast("string")))
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))

        def step(s: Column, j: Column) -> Column:
            p = s["p"] * mean / j
            return F.when(u <= s["cdf"], s).otherwise(F.struct((s["k"] + F.lit(1)).alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, b: a + b)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """source, rate: one row per source (pre-aggregated before the shuffle)."""
    size = F.greatest(F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)), F.lit(1)).cast("long")
    sizes = docs.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.sum(size).alias("__size"))
    if weights is None:
        sizes = sizes.withColumn("__target", F.pow(F.col("__size").cast("double"), F.lit(TEMPERATURE)))
    else:
        wanted = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__w string, __target double")
        sizes = sizes.join(wanted, F.col("__source").eqNullSafe(F.col("__w")), "left").na.fill(0.0, ["__target"])
    # scalar subqueries over one row per source: no join
    all_, targets = (sizes.agg(F.sum(c)).scalar() for c in ("__size", "__target"))
    return sizes.select("__source", F.when(targets > 0, F.col("__target") / targets * all_ / F.col("__size")).otherwise(F.lit(0.0)).alias("__rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED, source: str = "source", text: str = "text", doc_id: str = "doc_id", extra: bool = True) -> DataFrame:
    """All copies, globally shuffled.  extra: also copy_no (from 0), rate and shuffle_key, in place of columns of ``docs`` so called."""
    columns = [c for c in docs.columns if not (extra and c.lower() in RESERVED)]
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")))
    # the rates are written, so the planner knows their size and broadcasts them only below its threshold
    found = staged(rates(docs, weights, source, text).coalesce(1), "rates")
    # names of its own that no column of docs has
    of, rate, count, copy, place = (unused(c, docs) for c in ("mix_source", "mix_rate", "mix_count", "mix_copy", "mix_key"))
    rows = docs.join(found.toDF(of, rate), F.col(f"`{source}`").eqNullSafe(F.col(of)))
    rows = rows.withColumn(count, poisson(key, F.col(rate))).where(F.col(count) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    rows = rows.withColumn(place, F.md5(F.concat_ws("|", key, F.lit("copy"), F.col(copy).cast("string"))))
    rows = rows.repartition(partitions(docs.sparkSession), place).sortWithinPartitions(place)
    added = [F.col(copy).cast("int").alias("copy_no"), F.col(rate).alias("rate"), F.col(place).alias("shuffle_key")] if extra else []
    return rows.select(*[F.col(f"`{c}`") for c in columns], *added)
