"""Operator 12: source divergence audit.

How do the sources of a language differ in the words they use?  Terms are runs of
letters, A-Z lower-cased.  A language keeps the terms that occur in at least MIN_DOCS
of its documents.  With C the count of a kept term in a group (a source within a
language, or the language as a whole), N the sum of C over kept terms and V their
number, its share is p = 1 + floor(SCALE * (C + SMOOTH) / (N + SMOOTH * V)), in whole
numbers.  Two groups differ by the sum of the differences of their shares.

1. Sketch: each task counts, in a count-min sketch, in how many of its documents a
   (language, term) occurs; sketches are summed block by block in two steps, with
   counters that stop at 255.  A counter is never too small, so a term one of whose
   counters stays under MIN_DOCS is in too few documents.  Only one bit a counter, "reaches
   MIN_DOCS", is broadcast: DEPTH * MAX_CELLS / 8 bytes at most.
2. Count: in a second pass over the texts those terms are dropped before anything is
   shuffled; the others are summed by chunk, by task and by group, and their documents
   counted exactly.  Terms that the sketch let through by chance go here.
3. Pairs: shares of terms that a group does not have are all equal, so only
   occurring terms are joined.  With z the share of an absent term,

       sum |p - q| = V |z - y| + sum over terms of a (|p - y| - |z - y|) + sum over terms of b (|z - q| - |z - y|)
                     + sum over common terms (|p - q| - |p - y| - |z - q| + |z - y|)

   The first sums come from running totals over the distinct shares of each group, the
   last from a join of common terms, each pair of sources once; a term of many sources
   is dealt over blocks of sources.

The sketch has 16 counters a row and document, within MIN_CELLS and MAX_CELLS a row.
Beyond the upper bound it discards less and less, and more terms are shuffled; the
result is the same whatever it discards.

Null text, lang and source are ''.  Groups without terms, and languages without kept
terms, have their pairs, of value 0 where V is 0.  Repeated rows count each.  Ties: equal
values are ranked by the item's UTF-8 bytes.  An empty table gives an empty result.
Very long texts are counted whole.  Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import partitions, ship, staged

MIN_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
DEPTH, MIN_CELLS, MAX_CELLS, CELLS_A_DOC = 4, 1 << 20, 1 << 24, 16
#: Counters of a block of the sketch, and salts of the first step of their sum.
BLOCK, SALTS = 1 << 18, 16
#: Names held before they are entered in the sketch.
HELD = 1 << 20
#: Sources of a language that one block of a term's pairs has on one side.
SIDE = 256
SEEDS = [K.U64(x) for x in (0x51ED, 0xA11CE, 0xB0B0, 0xD1CE)]

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each term: its document and its number among the distinct terms, which follow.  Terms are compared whole."""
    inside = _TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    at = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    places = np.append(at[starts], at[-1])
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(K.LOWER[data[inside]])]).dictionary_encode()
    return np.searchsorted(offsets, starts, "right") - 1, np.asarray(found.indices).astype(np.int64), found.dictionary


def by_document(doc: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of each term of a document."""
    key, times = np.unique(doc * size + code, return_counts=True)
    return key // size, key % size, times


def string_names(strings: pa.Array) -> np.ndarray:
    data, offsets = K.text_buffer(strings)
    return K.span_hashes(data, offsets[:-1], offsets[1:])


def numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def cell(names: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (K.mix(names ^ SEEDS[row]) & K.U64(cells - 1)).astype(np.int64)


def sketched(rows: DataFrame, cells: int) -> DataFrame:
    """block, cells (counters from 0 to 255, compressed): one row a task and block, of rows (lang, source, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counters = np.zeros((DEPTH, cells), np.uint8)
        held: list[np.ndarray] = []

        def enter() -> None:
            names, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for row in range(DEPTH):
                at = cell(names, row, cells)
                order = np.argsort(at, kind="stable")
                places, first = np.unique(at[order], return_index=True)
                total = np.add.reduceat(times[order], first)
                counters[row, places] = np.minimum(counters[row, places] + total, 255)

        for batch in batches:
            data, offsets = K.text_buffer(batch.column(2))
            lang, langs = numbered(batch.column(0))
            lang_names = string_names(langs)
            for a, b in K.chunks(offsets):
                doc, code, terms = terms_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(doc):
                    continue
                doc, code, _ = by_document(doc, code, len(terms))
                held.append(K.pair(lang_names[lang[a + doc]], string_names(terms)[code]))
                if sum(map(len, held)) > HELD:
                    enter()
        if held:
            enter()
        squeeze = zstandard.ZstdCompressor(level=1)
        for i, part in enumerate(counters.reshape(-1, min(BLOCK, cells))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze.compress(part.tobytes())], pa.binary())], names=["block", "cells"])

    return rows.mapInArrow(work, "block int, cells binary")


def summed(sketches: DataFrame, cells: int) -> DataFrame:
    """One row a block that a task has: sums of counters, which stop at 255; blocks stream through, one array each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                block = batch.column(0)[i].as_py()
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(1)[i].as_py()), np.uint8)
                total[block] = np.minimum(total[block].astype(np.uint16) + part, 255).astype(np.uint8) if block in total else part
        squeeze = zstandard.ZstdCompressor(level=1)
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([squeeze.compress(part.tobytes())], pa.binary())], names=["block", "cells"])

    blocks = DEPTH * cells // min(BLOCK, cells)
    out = sketches.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    out = out.repartition(min(blocks * SALTS, partitions(sketches.sparkSession)), "block", "salt").select("block", "cells").mapInArrow(work, "block int, cells binary")
    return out.repartition(min(blocks, partitions(sketches.sparkSession)), "block").mapInArrow(work, "block int, cells binary")


def reached(sketches: DataFrame, cells: int, least: int) -> np.ndarray:
    """DEPTH rows of bits, packed: whether a counter reaches ``least``; at most DEPTH * MAX_CELLS / 8 bytes come to the driver."""
    size = min(BLOCK, cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for i in range(len(batch)):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(1)[i].as_py()), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([np.packbits(part >= least).tobytes()], pa.binary())], names=["block", "bits"])

    bits = np.zeros((DEPTH * cells // size, size // 8), np.uint8)
    for r in sketches.mapInArrow(work, "block int, bits binary").collect():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(DEPTH, -1)


def possible(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each name may be in enough documents."""
    ok = np.ones(len(names), bool)
    for row in range(DEPTH):
        at = cell(names, row, bits.shape[1] * 8)
        ok &= (bits[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def counted(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of possible terms, one row a chunk of texts and group."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(2))
            (lang, langs), (source, sources) = numbered(batch.column(0)), numbered(batch.column(1))
            lang_names = string_names(langs)
            group = lang * len(sources) + source
            for a, b in K.chunks(offsets):
                doc, code, terms = terms_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(doc):
                    continue
                doc, code, times = by_document(doc, code, len(terms))
                key, back = np.unique(group[a + doc] * len(terms) + code, return_inverse=True)
                n, docs = np.bincount(back, times).astype(np.int64), np.bincount(back)
                g, code = key // len(terms), key % len(terms)
                ok = possible(K.pair(lang_names[g // len(sources)], string_names(terms)[code]), shared.value)
                g, code = g[ok], code[ok]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(g // len(sources))), sources.take(pa.array(g % len(sources))), terms.take(pa.array(code)).cast(pa.string()), pa.array(n[ok]), pa.array(docs[ok].astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    return rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact; 0 where there are no terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    top, bottom = whole(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(whole(total + SMOOTH * terms), F.lit(0).cast("decimal(20,0)"))
    return F.coalesce(1 + F.floor((top - top % bottom) / bottom).cast("long"), F.lit(0).cast("long"))


def kept_terms(rows: DataFrame, least: int = MIN_DOCS, cells: int | None = None) -> DataFrame:
    """lang, source, term, n, n_lang of the kept terms of rows (lang, source, text) that a group has; written once."""
    if cells is None:
        cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (CELLS_A_DOC * max(1, rows.count()) - 1).bit_length()))
    bits = reached(summed(sketched(rows, cells), cells), cells, least)
    found = counted(rows, bits).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = found.withColumn("all_docs", F.sum("docs").over(term)).withColumn("n_lang", F.sum("n").over(term))
    return staged(found.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "n_lang"), "divergence-terms")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = MIN_DOCS, top: int = TOP, cells: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank.

    part "pair": item is each other source of the language, value the sum of the differences of shares, all ranks.
    part "term": item is each kept term that the source has and uses more than the language, value the difference, ranks to ``top``.
    """
    ship(docs.sparkSession)
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text"))
    terms = kept_terms(rows, least, cells)
    # V by language and N by group; all groups that occur, without reading a text
    sizes = terms.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("total_lang"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, ["lang"], "left")
    groups = groups.fillna(0, ["total", "own", "v", "total_lang"]).withColumn("absent", share(F.lit(0), F.col("total"), F.col("v")))
    groups = staged(groups, "divergence-groups")

    shares = terms.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    over = F.col("p") - share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    used = ranked(shares.withColumn("value", over).where("value > 0").withColumnRenamed("term", "item"), "term").where(F.col("rank") <= top)
    pairs = ranked(distances(docs.sparkSession, groups, staged(shares.select("lang", "source", "term", "p", "absent"), "divergence-shares")), "pair")
    return pairs.union(used)


def distances(spark: SparkSession, groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language, in both orders."""
    a, b = groups.alias("a"), groups.alias("b")
    both = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))
    pairs = a.join(b, both).select("a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.v"), F.col("a.own"), F.col("a.absent").alias("z"), F.col("b.absent").alias("y"))

    # sum of |p - y| over the terms of a, for all y at once: running totals over the distinct shares of a
    steps = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    none = F.lit(None)
    steps = steps.select("lang", "source", none.cast("string").alias("item"), F.col("p").alias("y"), "m", none.cast("long").alias("v"), none.cast("long").alias("own"), none.cast("long").alias("z"))
    asked = pairs.select("lang", "source", "item", "y", F.lit(0).cast("long").alias("m"), "v", "own", "z")
    every = Window.partitionBy("lang", "source")
    upto = every.orderBy("y", F.col("item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("m") * F.col("y")
    one = steps.union(asked).select("*", F.sum("m").over(upto).alias("below"), F.sum(mass).over(upto).alias("mass"), F.sum(mass).over(every).alias("all_mass")).where("item IS NOT NULL")
    z, y = F.col("z"), F.col("y")
    one = one.select("lang", "source", "item", "v", F.abs(z - y).alias("apart"), "own", (y * F.col("below") - F.col("mass") + (F.col("all_mass") - F.col("mass")) - y * (F.col("own") - F.col("below")) - F.col("own") * F.abs(z - y)).alias("part"))
    back = one.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("part").alias("other"))
    sums = one.select("lang", "source", "item", (F.col("v") * F.col("apart") + F.col("part")).alias("part")).join(back, ["lang", "source", "item"])

    # common terms, each pair of sources once
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // SIDE)
    dealt = F.pmod(F.xxhash64("source"), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")
    left = shares.withColumn("block", dealt).alias("a")
    right = (shares.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))) if blocks > 1 else shares.withColumn("block", dealt)).alias("b")
    c = F.col
    same = (c("a.lang") == c("b.lang")) & (c("a.term") == c("b.term")) & (c("a.block") == c("b.block")) & (c("a.source") < c("b.source"))
    excess = F.abs(c("a.p") - c("b.p")) - F.abs(c("a.p") - c("b.absent")) - F.abs(c("a.absent") - c("b.p")) + F.abs(c("a.absent") - c("b.absent"))
    common = left.join(right, same).groupBy(c("a.lang").alias("lang"), c("a.source").alias("source"), c("b.source").alias("item")).agg(F.sum(excess).alias("common"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    common = common.select("lang", turned.alias("x"), "common").select("lang", "x.source", "x.item", "common")
    return sums.join(common, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.col("part") + F.col("other") + F.coalesce("common", F.lit(0))).alias("value"))
