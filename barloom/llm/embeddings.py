"""Operator 1: embedding near-duplicates by a forest of random-projection trees.

Vectors of one label (and length) start in one root per tree.  A node of more than
2 * LEAF vectors is split by hyperplanes between random vectors of a bounded sample
(about SAMPLE vectors per node, see ``trees``); vectors near a hyperplane go to both
sides.  How near follows the node: a linked pair lies at most a chord of the threshold
apart, and a hyperplane's direction shows about spread / radius of a distance, with the
node's standard deviations along the direction and over all of them.  SPILL times that
product goes both ways, so nodes split alike in few dimensions and in a thousand, while
a node that is not much wider than the chord, where most pairs are links, would be
copied whole: it is a leaf.  Rounds of up to DEPTH levels go on until leaves are small or a
node no longer shrinks.  All vectors of a leaf are compared, in blocks of BLOCK, by
cosine in double precision.  A pair that shares several leaves, in one tree or in
several, counts in the smallest of them only, so links are counted exactly once and
no list of pairs is ever made: a block returns a count and a link to its smallest
neighbour for each vector.

Equal vectors (same label, same numbers) are one class from the start and count by
their number, so large groups of copies cost one comparison.

Vectors that are null, zero, or hold null or non-finite components, and those with a
null label, link with nothing and are components of their own.  Rows that repeat a
vec_id count as further vectors.  A null vec_id sorts below all others.  An empty table
gives an empty result.  Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._io import dropped, ship, staged
from .components import components, joins

TREES, LEAF, SPILL, DEPTH, SAMPLE, BLOCK, ROUNDS = 8, 64, 0.26, 6, 4096, 2048, 12
THRESHOLD = 0.93
#: A split counts only if neither side has more than this share of the node's vectors.
SHRINK = 0.75
#: Percentiles of a node's vectors that a hyperplane may go through; the middle one wins a tie.
CUTS = (50, 45, 55, 40, 60, 35, 65, 30, 70)
#: Rows of a node that one task splits.
PIECE = 4096


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long float lists, as doubles, each scaled by a power of two so that squares neither overflow nor vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chord(threshold: float) -> float:
    """How far apart unit vectors of that cosine are."""
    return float(np.sqrt(2 * (1 - threshold)))


def grow(x: np.ndarray, rate: float, seed: int, apart: float = chord(THRESHOLD)) -> list[tuple]:
    """A subtree over the sampled unit vectors: (direction, threshold, left, right, spill); a child below 0 is leaf -child - 1.

    apart: how far apart linked vectors are at most.
    """
    rng = np.random.default_rng(seed % 2**63)
    nodes: list[tuple] = []
    leaves = [0]

    def split(rows: np.ndarray, depth: int) -> int:
        if depth == DEPTH or len(rows) / rate <= LEAF or len(rows) < 8:
            leaves[0] += 1
            return -leaves[0]
        best = None
        for _ in range(4):
            i, j = rng.choice(len(rows), 2, replace=False)
            d = x[rows[i]] - x[rows[j]]
            if (size := np.linalg.norm(d)) < 1e-6:
                d, size = rng.standard_normal(x.shape[1]), np.sqrt(x.shape[1])
            p = x[rows] @ (d / size)
            # the two vectors themselves lie far out and do not count
            width = np.delete(p, (i, j)).std()
            if best is None or width > best[0]:
                best = (width, d / size, p)
        spread, d, p = best
        radius = np.sqrt(max(1 - float((x[rows].mean(0) ** 2).sum()), 1e-12))
        spill = SPILL * apart * float(spread) / radius
        # the hyperplane of the least work, as the sides' pairs: not through a dense group if there is room beside it
        sides = lambda m: ((p <= m + spill).mean(), (p > m - spill).mean())
        mid = min(np.percentile(p, CUTS), key=lambda m: sum(z * z for z in sides(m)))
        # vectors that lie close together all go both ways: such a node is a leaf, or it would be copied at every level
        if max(sides(mid)) > SHRINK:
            leaves[0] += 1
            return -leaves[0]
        mid = float(mid)
        me = len(nodes)
        nodes.append(())
        left = split(rows[p <= mid], depth + 1)
        right = split(rows[p > mid], depth + 1) if (p > mid).any() else left
        nodes[me] = (d, mid, left, right, spill)
        return me

    split(np.arange(len(x)), 0)
    return nodes


def descend(nodes: list[tuple], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves of the subtree; a row near a hyperplane goes both ways."""
    rows, leaf = [], []
    stack = [(0 if nodes else -1, np.arange(len(x)))]
    while stack:
        at, own = stack.pop()
        if at < 0:
            rows.append(own)
            leaf.append(np.full(len(own), -at - 1))
            continue
        d, mid, left, right, spill = nodes[at]
        p = x[own] @ d - mid
        if left == right:
            stack.append((left, own))
            continue
        stack.append((left, own[p <= spill]))
        stack.append((right, own[p > -spill]))
    return np.concatenate(rows), np.concatenate(leaf)


def trees(rows: DataFrame, vecs: DataFrame, apart: float) -> DataFrame:
    """node, tree: a subtree for each node (pid, node, n), from a sample of about SAMPLE of its vectors (all, if it has fewer)."""
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    chosen = rows.where(F.pmod(F.xxhash64("pid", "node"), F.lit(1 << 30)) < rate * (1 << 30)).join(vecs, F.col("pid") == F.col("__pid")).select("node", "n", "vec")

    def work(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        nodes = grow(unit(matrix(table.column("vec"))), min(1.0, SAMPLE / n), key[0].as_py(), apart)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(nodes)], pa.binary())})

    return chosen.groupBy("node").applyInArrow(work, "node long, tree binary")


def leaves(points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pid, node for all leaves; points: pid, root, vec.

    What goes from round to round is narrow; vectors are looked up only for nodes that are still split.
    """
    vecs = points.select(F.col("pid").alias("__pid"), "vec")
    rows = points.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("pid", F.xxhash64("root", "t").alias("node"), F.lit(-1).cast("long").alias("was"))
    done = None
    for _ in range(ROUNDS):
        rows = staged(rows, "forest-rows")
        sizes = rows.groupBy(F.col("node").alias("__node")).agg(F.count(F.lit(1)).alias("n"))
        # a node that hardly shrank is as dense as it gets: its pairs are compared in blocks
        more = (F.col("n") > 2 * LEAF) & ((F.col("was") < 0) | (F.col("n") < 0.8 * F.col("was")))
        sized = staged(rows.join(sizes, F.col("node") == F.col("__node")).select("pid", "node", "n", more.alias("more")), "forest-nodes")
        dropped(points.sparkSession, rows)
        final = sized.where(~F.col("more")).select("pid", "node")
        done = final if done is None else done.unionByName(final)
        big = sized.where("more").select("pid", "node", "n")
        if big.isEmpty():
            return done
        grown = trees(big, vecs, chord(threshold))
        counts = big.groupBy("node").agg(F.first("n").alias("n"))
        pieces = F.ceil(F.col("n") / F.lit(PIECE)).cast("int")
        copies = grown.join(counts, "node").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select("node", "piece", "tree")
        parts = big.join(vecs, F.col("pid") == F.col("__pid")).select("pid", "node", "n", "vec", F.pmod(F.xxhash64("pid"), pieces).cast("int").alias("piece"))

        def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("pid", pa.int64()), ("node", pa.int64()), ("was", pa.int64())])
            if not len(left):
                return schema.empty_table()
            nodes = pickle.loads(right.column("tree")[0].as_py())
            row, leaf = descend(nodes, unit(matrix(left.column("vec"))))
            node = np.full(len(row), key[0].as_py(), np.int64).view(K.U64)
            pid, n = (np.asarray(left.column(c))[row] for c in ("pid", "n"))
            return pa.Table.from_arrays([pa.array(pid), pa.array(K.pair(node, leaf.astype(K.U64)).view(np.int64)), pa.array(n)], schema=schema)

        rows = parts.groupBy("node", "piece").cogroup(copies.groupBy("node", "piece")).applyInArrow(work, "pid long, node long, was long")
    return done.unionByName(rows.select("pid", "node"))


def compared(points: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """pid, links, low: from each block, the links counted there and the smallest vector linked in it."""
    own = found.groupBy(F.col("pid").alias("__pid")).agg(F.collect_set("node").alias("nodes"))  # as many as trees and spill give
    sizes = found.groupBy(F.col("node").alias("__node")).agg(F.countDistinct("pid").alias("n"))
    rows = points.join(own, F.col("pid") == F.col("__pid")).select("pid", "vec", "n_rows", "nodes", F.explode("nodes").alias("node"))
    rows = rows.join(sizes.where("n > 1"), F.col("node") == F.col("__node"))
    rows = rows.withColumn("k", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("pid"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("pid", "vec", "n_rows", "nodes", "node", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        node, lo, hi = (k.as_py() for k in key)
        mine = np.asarray(table.column("mine"))
        order = np.argsort(mine != lo, kind="stable")
        table, mine = table.take(pa.array(order)), mine[order]
        pid, weight, x = np.asarray(table.column("pid")), np.asarray(table.column("n_rows")), matrix(table.column("vec"))
        n, cut = len(pid), int((mine == lo).sum())
        size = np.sqrt((x * x).sum(axis=1))
        rows, cols = (slice(0, n), slice(0, n)) if lo == hi else (slice(0, cut), slice(cut, n))
        hit = x[rows] @ x[cols].T / (size[rows, None] * size[None, cols]) >= threshold
        if lo == hi:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return pa.table({"pid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        # pairs that share a smaller leaf count there
        lists = table.column("nodes").combine_chunks()
        flat, owner = np.asarray(lists.flatten()), np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
        before = flat < node
        names, which = np.unique(flat[before], return_inverse=True)
        member = np.zeros((n, len(names)), np.float32)
        member[owner[before], which] = 1
        fresh = hit & (member[rows] @ member[cols].T == 0)
        links, low = np.zeros(n, np.int64), pid.copy()
        links[rows] += fresh @ weight[cols]
        if lo != hi:
            links[cols] += weight[rows] @ fresh
        big = np.iinfo(np.int64).max
        low[rows] = np.minimum(low[rows], np.where(hit, pid[cols][None, :], big).min(axis=1))
        if lo != hi:
            low[cols] = np.minimum(low[cols], np.where(hit, pid[rows][:, None], big).min(axis=0))
        # a vector's smallest neighbour alone may leave a component in parts: add what joins them
        touched = (links > 0) | (low < pid)
        extra = joins(hit, pid, rows, cols, lo == hi)
        out_pid = np.concatenate([pid[touched], extra[:, 0]])
        return pa.table({"pid": pa.array(out_pid), "links": pa.array(np.concatenate([links[touched], np.zeros(len(extra), np.int64)])), "low": pa.array(np.concatenate([low[touched], extra[:, 1]]))})

    return rows.groupBy("node", "lo", "hi").applyInArrow(work, "pid long, links long, low long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("pid", F.when(usable, F.xxhash64("label", "vec")))
    usables = rows.where("pid is not null")
    points = usables.groupBy("pid", "label", "vec").agg(F.count(F.lit(1)).alias("n_rows"), F.min("vec_id").alias("first_id"))
    points = staged(points.select("pid", F.xxhash64("label", F.size("vec")).alias("root"), "vec", "n_rows", "first_id"), "forest-points")
    found = staged(leaves(points.select("pid", "root", "vec"), threshold), "forest-leaves")
    pairs = staged(compared(points, found, threshold), "forest-links")
    groups = components(pairs.select(F.col("pid").alias("a"), F.col("low").alias("b")))
    counts = pairs.groupBy(F.col("pid").alias("__l")).agg(F.sum("links").alias("links"))
    nodes = points.select("pid", "n_rows", "first_id").join(counts, F.col("pid") == F.col("__l"), "left").join(groups.withColumnRenamed("node", "__g"), F.col("pid") == F.col("__g"), "left")
    nodes = nodes.select(F.col("pid").alias("__p"), (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), F.coalesce("component", "pid").alias("__c"), "first_id")
    ids = nodes.groupBy(F.col("__c").alias("__k")).agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(ids, F.col("__c") == F.col("__k")).select("__p", "n_links", "component_id")
    out = rows.select("vec_id", "pid").join(nodes, F.col("pid") == F.col("__p"), "left")
    component = F.when(F.col("pid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
