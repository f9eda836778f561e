"""Operator 5: MinHash near-deduplication of multisets, by BagMinHash.

A document is the multiset of its runs of SHINGLE words (words as in lm, A-Z
lower-cased; a shorter document is one run).  For each shingle of count c, Poisson
processes run over the weights (0, c], split hierarchically into the dyadic blocks
(0, 1], (1, 2], (2, 4], (4, 8], ...: a block's points come at the rate of its width
and count if their weight is at most c.  Every point falls on one of the COMPONENTS
positions of the signature, which keeps its earliest point.  Two signatures agree
at a position with probability equal to the weighted Jaccard similarity, and a
document needs about COMPONENTS * ln(COMPONENTS) points however long it is.

Documents with the same words in the same order are one class from the start.
Signatures are banded; candidates of a bucket are linked to its smallest member
first, by verification of the whole multisets.  Then the pairs of a bucket that are
still in different groups are compared by signature, in blocks; what may be a near
copy across groups forms families, and within a family such pairs are verified
until their groups are joined.  No bucket is capped and no pairs are listed.

Null, empty and blank texts have no shingles: each is a group of its own.  Rows
with the same doc_id fall in one group only if their texts do; rows that repeat
the kept doc_id in a group all stay.  A null doc_id sorts below all others.  Ties:
the smallest doc_id of a group stays.  An empty table gives an empty result.
Further columns, whatever their names, pass through representatives() unchanged.  A very
long text is signed and compared whole, as a batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import ship, staged
from .components import components, joins

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 6
COMPONENTS = BANDS * ROWS
#: A pair whose signatures agree less is not verified: five standard deviations below THRESHOLD.
ESTIMATE = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / COMPONENTS) ** 0.5
BATCH_BYTES = 2 << 20
#: Members of a bucket or family compared in one block, and bytes of their multisets.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Tasks over which the members of a bucket or family are dealt where they learn its size.
SALTS = 16


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by document in order of (document, name): document, name, count; then word names and offsets."""
    words, at = K.words_of(data, offsets, True)
    names, s_at = K.shingles(words, at, SHINGLE)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(s_at))
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])])) if len(names) else np.zeros(0, np.int64)
    return doc[new], names[new], np.diff(np.append(new, len(names))), words, at


def signatures(doc: np.ndarray, name: np.ndarray, count: np.ndarray, docs: int, slack: float = 3.0) -> np.ndarray:
    """docs x COMPONENTS names of earliest points (0 for documents without shingles).

    Points are made up to a stop by which all positions are likely filled; the few documents
    where one is not are done again with a later stop.
    """
    m = COMPONENTS
    weight = np.bincount(doc, count, minlength=docs)
    stop = m / np.maximum(weight, 1) * (np.log(m) + slack)
    best, out = np.full(docs * m, np.inf), np.zeros(docs * m, K.U64)
    # one process for each element and dyadic block of weights
    blocks = np.ceil(np.log2(count)).astype(np.int64) + 1
    element = np.repeat(np.arange(len(name)), blocks)
    block = K.ranges(np.zeros(len(name), np.int64), blocks)
    low = np.where(block > 0, 2.0 ** (block - 1.0), 0.0)
    width = np.where(block > 0, low, 1.0)
    seed, owner, most = K.pair(name[element], block.astype(K.U64)), doc[element], count[element]
    x, until = np.zeros(len(element)), stop[owner]
    step = 0
    while len(x):
        span = 1 if step < 4 else 4 if step < 32 else 32
        steps = np.arange(step + 1, step + span + 1, dtype=K.U64)
        h = K.mix(seed[:, None] + steps[None, :] * K.MULT)
        gap = -np.log(((h >> K.U64(11)).astype(float) + 0.5) / 2.0**53) / width[:, None]
        gap[:, 0] += x
        times = np.cumsum(gap, axis=1)
        row, col = np.nonzero(times <= until[:, None])
        second = K.mix(h[row, col] ^ K.PAIR)
        level = low[row] + np.floor((second >> K.U64(11)).astype(float) / 2.0**53 * width[row])
        good = level < most[row]
        row, col, second = row[good], col[good], second[good]
        place, when = owner[row] * m + (K.mix(second + K.MULT) % K.U64(m)).astype(np.int64), times[row, col]
        np.minimum.at(best, place, when)
        first = best[place] == when
        out[place[first]] = second[first]
        x = times[:, -1]
        live = x <= until
        seed, owner, most, low, width, until, x = (v[live] for v in (seed, owner, most, low, width, until, x))
        step += span
    out = out.reshape(docs, m)
    again = np.flatnonzero(np.isinf(best.reshape(docs, m)).any(axis=1) & (weight > 0))
    if len(again):
        renumber = np.full(docs, -1)
        renumber[again] = np.arange(len(again))
        mine = renumber[doc] >= 0
        out[again] = signatures(renumber[doc[mine]], name[mine], count[mine], len(again), slack + 4)
    return out


def node_names(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name for each document's sequence of words."""
    raw = words.tobytes()
    digest = lambda s, e: hashlib.blake2b(raw[8 * s : 8 * e], digest_size=8).digest()
    return np.array([int.from_bytes(digest(s, e), "little", signed=True) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)


def bands(sig: np.ndarray) -> np.ndarray:
    """docs x BANDS names of bands; the band's number is part of the name."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    names = np.broadcast_to(np.arange(BANDS, dtype=K.U64), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        names = K.pair(names, parts[:, :, j])
    return names


def content_of(text: Column) -> Column:
    """A digest that tells texts of one doc_id apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, content, node (the words' name; null for none), sig (a byte a position) and bands (array of long)."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for a, b in K.chunks(offsets, BATCH_BYTES):
                doc, name, count, words, at = multisets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sig = signatures(doc, name, count, b - a)
                empty = np.diff(at) == 0
                node = node_names(words, at)
                low = (sig & K.U64(0xFF)).astype(np.uint8)
                cols = [
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(node, mask=empty), pa.array([None if z else r.tobytes() for z, r in zip(empty, low)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands(sig).view(np.int64).ravel())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "content", "node", "sig", "bands"])

    own = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), own.alias("text"), content_of(own).alias("content")).mapInArrow(work, "doc_id long, content binary, node long, sig binary, bands array<long>")


def agreement(a: list[bytes] | np.ndarray, b: list[bytes] | np.ndarray) -> np.ndarray:
    """Estimated similarity of paired one-byte signatures, chance agreement taken off."""
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, COMPONENTS) for v in (a, b))
    return ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def promising(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures agree well enough to be verified, with their estimate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            est = agreement(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if len(batch) else np.zeros(0)
            keep = pa.array(est >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(est[est >= ESTIMATE])], names=["a", "b", "est"])

    left, right = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long, est double")


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    x, y = np.frombuffer(a, K.U64), np.frombuffer(b, K.U64)
    (xn, xc), (yn, yc) = (np.split(v, 2) for v in (x, y))
    _, i, j = np.intersect1d(xn, yn, assume_unique=True, return_indices=True)
    both = int(np.minimum(xc[i], yc[j]).sum())
    return both / max(1, int(xc.sum()) + int(yc.sum()) - both)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """node, bag for each row of ``docs`` (node, text): its distinct shingles and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for a, b in K.chunks(offsets):
                doc, name, count, words, at = multisets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cut = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                bags = [name[s:e].tobytes() + count[s:e].astype(K.U64).tobytes() for s, e in zip(cut[:-1], cut[1:])]
                # a doc_id may repeat with other words: only the text that has the node's words counts
                own = pa.array(node_names(words, at) == np.asarray(batch.column(0).slice(a, b - a)))
                got = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bags, pa.binary())], names=["node", "bag"])
                yield got.filter(own)

    return docs.select("node", F.col(f"`{text}`").alias("text")).mapInArrow(work, "node long, bag binary")


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs a, b whose multisets overlap by THRESHOLD or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [overlap(x.as_py(), y.as_py()) >= THRESHOLD for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def blocks(members: DataFrame) -> DataFrame:
    """Rows for each pair of blocks of a group: its n members and bytes over BLOCK and BLOCK_BYTES, so a large group is many tasks."""
    rows = members.withColumn("__k", F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")).drop("bytes")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("__k")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return rows.withColumns({"lo": F.least("mine", "__other"), "hi": F.greatest("mine", "__other")}).drop("__k", "__other")


def sides(key: tuple, table: pa.Table) -> tuple[pa.Table, slice, slice, bool]:
    """A block pair's rows, those of the lower block first, and where both blocks are."""
    mine = np.asarray(table.column("mine"))
    lo, hi = key[1].as_py(), key[2].as_py()
    table = table.take(pa.array(np.argsort(mine != lo, kind="stable")))
    n, cut = len(mine), int((mine == lo).sum())
    return (table, slice(0, n), slice(0, n), True) if lo == hi else (table, slice(0, cut), slice(cut, n), False)


def alike(table: pa.Table, rows: slice, cols: slice) -> np.ndarray:
    """Which pairs are of different groups and have signatures that agree well enough."""
    comp = np.asarray(table.column("comp"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COMPONENTS)
    need = int(np.ceil((ESTIMATE * (1 - 1 / 256) + 1 / 256) * COMPONENTS - 1e-9))
    hit = comp[rows, None] != comp[None, cols]
    left, right = sig[rows], sig[cols]
    for i in np.flatnonzero(hit.any(axis=1)):
        hit[i] &= (right == left[i]).sum(axis=1) >= need
    return hit


def families(members: DataFrame) -> DataFrame:
    """Links that join all pairs of a bucket which may be near copies but are in different groups, at most one a member and block.

    members: bucket, node, comp, sig, n (members of the bucket), bytes (0).
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table, rows, cols, same = sides(key, table)
        got = joins(alike(table, rows, cols), np.asarray(table.column("node")), rows, cols, same)
        return pa.table({"a": pa.array(got[:, 0], pa.int64()), "b": pa.array(got[:, 1], pa.int64())})

    return blocks(members).groupBy("bucket", "lo", "hi").applyInArrow(work, "a long, b long").distinct()


def settled(members: DataFrame) -> DataFrame:
    """Links between groups of a family, each verified on the whole multisets.

    members: family, node, comp, sig, bag, n (members of the family), bytes (of its bags).  Pairs are compared until their groups are
    joined, so a block gives no more links than it has groups.
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table, rows, cols, same = sides(key, table)
        hit = alike(table, rows, cols)
        node, bag, offset = np.asarray(table.column("node")), table.column("bag").to_pylist(), 0 if same else cols.start
        group: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := group.get(c, c)) != c:
                c = up
            return c

        comp, out = np.asarray(table.column("comp")).tolist(), []
        for i, j in zip(*np.nonzero(hit)):
            j = int(j) + offset
            if same and j <= i or root(comp[i]) == root(comp[j]) or overlap(bag[i], bag[j]) < THRESHOLD:
                continue
            group[root(comp[i])] = root(comp[j])
            out.append((max(node[i], node[j]), min(node[i], node[j])))
        got = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return blocks(members).groupBy("family", "lo", "hi").applyInArrow(work, "a long, b long")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    # by doc_id and content, as an id may repeat with other texts
    kept = classes(docs, text, doc_id, content=True).where("kept").select("doc_id", "content").distinct()
    same = docs[f"`{doc_id}`"].cast("long").eqNullSafe(kept["doc_id"]) & (content_of(docs[f"`{text}`"]) == kept["content"])
    return docs.join(kept, same, "left_semi")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", content: bool = False) -> DataFrame:
    """doc_id, class_id (the group's smallest doc_id), kept, class_size: one row per row of ``docs``.

    content: also a column of that name, SHA-256 of the text (null as empty).
    """
    sigs = staged(signed(docs, text, doc_id), "bag-signatures")
    # equal word sequences are one node; its signature is the same in every row
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "content")).alias("of"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = staged(nodes, "bag-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    low = buckets.groupBy(F.col("bucket").alias("__b")).agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(buckets.join(low, F.col("bucket") == F.col("__b")).select("bucket", "node", "low", "n"), "bag-buckets")
    star = shared.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    star = staged(promising(star, nodes), "bag-star")

    # texts of what may be verified, each once
    wanted = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    # by id and content, as rows without an id, or with a much-repeated one, are many
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), content_of(F.col(f"`{text}`")).alias("content"), F.col(f"`{text}`").alias("text"))

    def bags_of(wanted: DataFrame) -> DataFrame:
        ids = nodes.join(wanted, "node").select("node", F.col("of.doc_id").alias("__id"), F.col("of.content").alias("__content"))
        found = some.join(ids, (F.col("content") == F.col("__content")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
        return packed(found).groupBy("node").agg(F.first("bag").alias("bag"))

    bags = staged(bags_of(wanted), "bag-texts")
    # first the best candidate of each, then the other stars that still join different groups
    best = star.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    links = staged(verified(best, bags), "bag-links")
    groups = staged(components(links), "bag-groups")

    def grouped(df: DataFrame, node: str, name: str) -> DataFrame:
        g = groups.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        return df.join(g, F.col(node) == F.col("__n"), "left").withColumn(name, F.coalesce("__c", node)).drop("__n", "__c")

    rest = grouped(grouped(star, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti")
    links = staged(links.unionByName(verified(rest, bags)), "bag-links")
    groups = staged(components(links), "bag-groups")

    # buckets that still hold several groups: families of nodes that may be near copies across them, then all their pairs
    sig = nodes.select(F.col("node").alias("__s"), "sig")

    def several(rows: DataFrame, key: str) -> DataFrame:
        mixed = rows.groupBy(F.col(key).alias("__b")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("lo <> hi")
        mixed = mixed.select("__b", "n", "bytes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        return rows.drop("size").join(mixed, (F.col(key) == F.col("__b")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("__salt"))).drop("__b", "__salt")

    members = several(grouped(shared.select("bucket", "node", F.lit(0).alias("size")), "node", "comp"), "bucket").join(sig, F.col("node") == F.col("__s"))
    kin = components(staged(families(members.select("bucket", "node", "comp", "sig", "n", "bytes")), "bag-families"))
    kin = staged(kin.select("node", F.col("component").alias("family")), "bag-kin")
    rest = staged(bags_of(kin.select("node").join(wanted, "node", "left_anti")), "bag-texts")
    both = bags.unionByName(rest).select(F.col("node").alias("__t"), "bag")
    sized = kin.join(both.select(F.col("__t"), F.octet_length("bag").alias("size")), F.col("node") == F.col("__t")).drop("__t")
    members = several(grouped(sized, "node", "comp"), "family").join(sig, F.col("node") == F.col("__s")).join(both, F.col("node") == F.col("__t"))
    links = staged(links.unionByName(settled(members.select("family", "node", "comp", "sig", "bag", "n", "bytes"))), "bag-links")
    groups = components(links)

    whole = grouped(nodes.select("node", "doc_id", "rows"), "node", "comp")
    ids = whole.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    of = whole.select("node", "comp").join(ids, "comp").select(F.col("node").alias("__n"), "class_id", "class_size")
    out = sigs.select("doc_id", "content", "node").join(of, F.col("node") == F.col("__n"), "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", *["content"] * content, F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))
