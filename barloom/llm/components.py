"""Connected components of a graph of links, in DataFrames alone.

Rounds of three steps, the same at every size, until the links are settled:

1. large-star: each node links its larger neighbours to the smallest node it knows,
2. small-star: each node links its smaller neighbours likewise,
3. passes without a shuffle, in which each task joins what its own links connect and
   writes them again.  Spark reads small files together, so a pass leaves fewer, fuller
   parts, and passes go on as long as their number halves.

Minima are aggregates with map-side combining and go back to the links by a join
that adaptive execution may split, so a node with very many links is no hot spot.
Links are written to the shared folder after each step; nothing but whether they
are settled reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import dropped, ship, staged

ROUNDS = 60
#: Links that a task joins at a time.
TOGETHER = 200_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (a > b), each link once.  One large-star or small-star step."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
        out = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        out = edges.join(low, F.col("a") == F.col("n")).select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def joins(hit: np.ndarray, pid: np.ndarray, rows: slice, cols: slice, same: bool) -> np.ndarray:
    """Links (pid, smallest pid of its component in this block): at most one for each vector."""
    n = len(pid)
    full = np.zeros((n, n), bool)
    full[rows, cols] = hit
    if not same:
        full[cols, rows] = hit.T
    label = np.full(n, -1)
    out = []
    for i in np.argsort(pid):
        if label[i] >= 0 or not full[i].any():
            continue
        label[i] = i
        front = np.array([i])
        while len(front):
            nxt = np.flatnonzero(full[front].any(axis=0) & (label < 0))
            label[nxt] = i
            out.append(np.column_stack([pid[nxt], np.full(len(nxt), pid[i])]))
            front = nxt
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of each component of these links, and that smallest node."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(node))
    while True:
        p, q = top[x], top[y]
        apart = p != q
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
    rest = np.flatnonzero(top != np.arange(len(node)))
    return node[rest], node[top[rest]]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, each component of TOGETHER links as a star around its smallest node."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in united(a, b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            yield flush()
            held = []
    if held:
        yield flush()


def _settled(edges: DataFrame) -> bool:
    """All links lead from a node straight to its root: no node has two, and no root has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR (up = 1 AND root = 1)").isEmpty()


def _joined(edges: DataFrame) -> DataFrame:
    """Passes over written links in which each task joins its own, while their parts halve in number."""
    spark = edges.sparkSession
    parts = edges.rdd.getNumPartitions()
    while True:
        after = staged(edges.mapInArrow(_combined, "a long, b long"), "links")
        dropped(spark, edges)
        edges, before, parts = after, parts, after.rdd.getNumPartitions()
        if before == 1 or parts * 2 > before:
            return edges


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of a link; component is the smallest node reachable."""
    spark = links.sparkSession
    ship(spark)
    edges = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b"), "links")
    for _ in range(ROUNDS):
        after = staged(_star(_star(edges, True), False).distinct(), "links")
        dropped(spark, edges)
        edges = _joined(after)
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
