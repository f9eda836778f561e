"""Exact top-k by cosine for many queries, with a pruning index.

Vectors of length one are dealt to the nearest of PIVOTS pivots and keep their angle to it, in order of pivot and angle.
The angle between a query q and a vector v is at least |angle(q, p) - angle(v, p)|, so once a query knows k vectors
within an angle r, only vectors of a cell p between angle(q, p) - r and angle(q, p) + r can be nearer.

1. Each query is compared with its nearest cells that hold k vectors; the k-th angle found is its r.
2. Each query is compared with what the bound leaves of the other cells.

Results are those of a full scan.  How much is skipped depends on the vectors: clustered ones are mostly skipped,
directions without any structure in many dimensions are not.  Pivots come from a bounded sample of SAMPLE vectors;
every vector is indexed.

Queries go through in blocks of QUERY_BLOCK: what is broadcast is bounded, and is gone before the next block's is sent.
Null vectors and those without a length have no similarity and are in no result.  Similarities within 1e-12 are equal,
and ids break ties.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barloom.operators.relational import top_per
from barloom.session import shared_dir, ship

PIVOTS, SAMPLE, QUERY_BLOCK = 64, 4096, 2048
#: Queries compared at once with a run of one cell's vectors.
SIDE = 64
#: Angles that differ by less may be equal.
SLACK = 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which have a length; scaled first, so that squares stay finite."""
    top = np.abs(x).max(1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    x = np.where(ok[:, None], x, 0) / np.where(ok, top, 1)[:, None]
    return x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None], ok


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n rows (or all), each as far as can be from those before."""
    if not len(x):
        return x
    chosen, near = [0], angles(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > SLACK:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


@dataclass
class PivotIndex:
    """rows: vec_id, cell, angle, unit, in order of cell and angle.  cells: of each cell, vectors, least and largest angle."""

    rows: DataFrame
    pivots: np.ndarray
    cells: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, pivots: int = PIVOTS, vec: str = "embedding", id_column: str = "vec_id") -> PivotIndex:
        """Written to ``path``, or to the shared folder."""
        spark = vectors.sparkSession
        ship(spark)
        kind = vectors.schema[id_column].dataType
        rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        found, ok = units(matrix(sample))
        chosen = farthest_first(found[ok], pivots)
        shared = spark.sparkContext.broadcast(chosen)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x, ok = units(matrix(batch.column(1)))
                x = x[ok]
                far = angles(x, shared.value)
                cell = far.argmin(1) if len(x) else np.zeros(0, np.int64)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), unit], names=["vec_id", "cell", "angle", "unit"])

        dealt = rows.mapInArrow(work, f"vec_id {kind.simpleString()}, cell int, angle double, unit array<double>")
        path = path or f"{shared_dir(spark)}/barloom-vectors-{uuid.uuid4().hex}"
        dealt.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.parquet(f"{path}/rows")
        spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(chosen)], "cell int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PivotIndex:
        ship(spark)
        rows = spark.read.parquet(f"{path}/rows")
        pivots = np.array([r.pivot for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()], float)
        cells = np.zeros((len(pivots), 3))
        for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
            cells[r.cell] = r.n, r.low, r.high
        return cls(rows, pivots, cells)

    def _compared(self, shared, k: int, kind) -> DataFrame:
        """query (number in the block), vec_id, similarity, compared: k rows a query and task, and a row with the task's number of comparisons.

        shared: broadcast (unit queries, angles to pivots, reach of each query in each cell, floor).
        """
        schema = pa.schema([("query", pa.int32()), ("vec_id", to_arrow_type(kind)), ("similarity", pa.float64()), ("compared", pa.int64())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, far, reach, floor = shared.value
            query, vec, sim, compared = np.zeros(0, np.int64), pa.array([], schema.field("vec_id").type), np.zeros(0), 0
            for batch in batches:
                cell, angle, unit = np.asarray(batch.column(1)), np.asarray(batch.column(2)), matrix(batch.column(3))
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
                got = [(query, np.arange(len(vec)), sim)]
                for a, b in zip(starts, np.append(starts[1:], len(cell))):
                    c = cell[a]
                    low, high = a + np.searchsorted(angle[a:b], far[:, c] - reach[:, c], "left"), a + np.searchsorted(angle[a:b], far[:, c] + reach[:, c], "right")
                    live = np.flatnonzero(high > low)
                    live = live[np.argsort(low[live], kind="stable")]
                    for i in range(0, len(live), SIDE):
                        own = live[i : i + SIDE]
                        x, y = low[own].min(), high[own].max()
                        s = np.round(q[own] @ unit[x:y].T, 12)
                        compared += s.size
                        least = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                        at, col = np.nonzero((s >= least[:, None]) & (s >= floor))
                        got.append((own[at], len(vec) + x + col, s[at, col]))
                query, place, sim = (np.concatenate(z) for z in zip(*got))
                found = pa.concat_arrays([vec, batch.column(0).cast(vec.type)]).take(pa.array(place))
                order = pa.compute.sort_indices(pa.table({"q": query, "s": -sim, "v": found}), [("q", "ascending"), ("s", "ascending"), ("v", "ascending")])
                query, sim = query[order], sim[order]
                kept = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) < k)
                query, sim, vec = query[kept], sim[kept], found.take(order).take(pa.array(kept))
            none = [pa.array([None], schema.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), vec, pa.array(sim), pa.nulls(len(query), pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays([*none, pa.array([compared])], schema=schema)

        # cells that no query of the block reaches are not read: files are in order of cell
        reached = np.flatnonzero((shared.value[2] >= 0).any(0))
        rows = self.rows.where(F.col("cell").isin(reached.tolist())).select("vec_id", "cell", "angle", "unit")
        return rows.mapInArrow(work, f"query int, vec_id {kind.simpleString()}, similarity double, compared long")

    def _pass(self, block: tuple, k: int, kind, into: str) -> DataFrame:
        """query (number in the block), vec_id, similarity: k a query, of the cells that the block's queries reach."""
        spark = self.rows.sparkSession
        shared = spark.sparkContext.broadcast(block)
        found, path = self._compared(shared, k, kind), f"{into}/tasks-{uuid.uuid4().hex}"
        found.write.parquet(path)
        shared.destroy()
        found = spark.read.schema(found.schema).parquet(path)
        found.where("query IS NULL").agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")).write.mode("append").parquet(f"{into}/compared")
        return top_per(found.where("query IS NOT NULL").drop("compared"), ["query"], k, F.col("similarity").desc(), F.col("vec_id"))

    def topk(self, queries: DataFrame, k: int, floor: float | None = None, query: str = "query", vec: str = "qvec", into: str | None = None) -> DataFrame:
        """query, vec_id, similarity of the k most similar vectors of each query, from ``floor`` on.

        Blocks are written one after the other to ``into`` or the shared folder; ``{into}/compared`` has the comparisons of each pass.
        """
        spark, kind = self.rows.sparkSession, self.rows.schema["vec_id"].dataType
        into = into or f"{shared_dir(spark)}/barloom-topk-{uuid.uuid4().hex}"
        rows = queries.select(F.col(query).alias("query"), F.col(vec).cast("array<double>").alias("q")).where("q IS NOT NULL AND size(q) > 0 AND NOT exists(q, x -> x IS NULL)")
        blocks = max(1, -(-rows.count() // QUERY_BLOCK))
        for b in range(blocks):
            block = rows.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow()
            names = block.column("query").combine_chunks()
            q, ok = units(matrix(block.column("q").combine_chunks()))
            names, q = names.filter(pa.array(ok)), q[ok]
            if len(q) and len(self.pivots):
                self._block(names, q, k, -2.0 if floor is None else floor, kind, queries.schema[query].dataType, into)
        result = f"query {queries.schema[query].dataType.simpleString()}, vec_id {kind.simpleString()}, similarity double"
        spark.createDataFrame([], result).write.mode("append").parquet(f"{into}/found")
        return spark.read.schema(result).parquet(f"{into}/found")

    def _block(self, names: pa.Array, q: np.ndarray, k: int, floor: float, kind, name_kind, into: str) -> None:
        spark = self.rows.sparkSession
        far = angles(q, self.pivots)
        n, low, high = self.cells.T
        # the nearest cells that hold k vectors together
        order = np.argsort(far, axis=1)
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= n > 0
        seen = self._pass((q, far, np.where(first, 2 * np.pi, -1.0), floor), k, kind, into)
        kth = np.full(len(q), floor)
        for r in seen.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).where(F.col("n") == k).collect():  # a row a query of the block
            kth[r.query] = max(floor, r.least)
        reach = np.where(kth < -1, np.pi, np.arccos(np.clip(kth, -1, 1))) + SLACK
        near = (far - reach[:, None] <= high) & (far + reach[:, None] >= low) & (n > 0)
        best = self._pass((q, far, np.where(near, reach[:, None], -1.0), floor), k, kind, into)
        named = spark.createDataFrame(pa.table({"n": pa.array(np.arange(len(names)), pa.int32()), "name": names}))
        best.join(F.broadcast(named), F.col("query") == F.col("n")).select(F.col("name").cast(name_kind).alias("query"), "vec_id", "similarity").write.mode("append").parquet(f"{into}/found")
