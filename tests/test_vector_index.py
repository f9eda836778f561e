"""Exact top-k by the pruning index against a full scan, and the share of vectors that it compares."""

import numpy as np
import pytest

from barloom.operators import vector_index
from barloom.operators.vector_index import PivotIndex


def clustered(n=3000, dims=48, clusters=40, seed=1, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    return centres[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, dims))


def table(spark, x, name="vec_id", vec="embedding", ids=None):
    return spark.createDataFrame([(i, v.tolist() if v is not None else None) for i, v in zip(ids or range(len(x)), x)], f"{name} long, {vec} array<double>")


def brute(x, q, k, floor=None):
    size = lambda z: np.linalg.norm(z, axis=-1)
    out = {}
    for i, v in enumerate(q):
        s = np.round(x @ v / (size(x) * size(v)), 12)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if floor is None or s[j] >= floor][:k]
        out[i] = [(int(j), pytest.approx(s[j], abs=1e-9)) for j in order]
    return {i: v for i, v in out.items() if v}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query, []).append((r.vec_id, r.similarity))
    return {i: sorted(v, key=lambda p: (-p[1], p[0])) for i, v in out.items()}


def test_clustered_vectors_are_mostly_skipped(spark, tmp_path):
    x = clustered()
    q = x[::30]
    index = PivotIndex.build(table(spark, x), str(tmp_path / "i"))
    assert index.rows.count() == len(x)
    found = index.topk(table(spark, q, "query", "qvec"), 7, into=str(tmp_path / "o"))
    assert got(found) == brute(x, q, 7)
    share = spark.read.parquet(str(tmp_path / "o/compared")).agg({"compared": "sum"}).first()[0] / (len(x) * len(q))
    print(f"share of vectors compared: {share:.3f}")
    assert share < 0.25


@pytest.mark.parametrize("floor", [None, 0.3])
def test_vectors_without_structure(spark, tmp_path, monkeypatch, floor):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 9)
    x = np.random.default_rng(5).standard_normal((700, 8))
    x[40:60] = x[3]  # ties: ids decide
    q = np.concatenate([x[::31], -x[:2]])
    index = PivotIndex.build(table(spark, x), str(tmp_path / "i"), pivots=12)
    found = index.topk(table(spark, q, "query", "qvec"), 25, floor, into=str(tmp_path / "o"))
    assert got(found) == brute(x, q, 25, floor)


def test_full_scans_block_by_block(spark, monkeypatch):
    from barloom.operators import retrieval as V

    monkeypatch.setattr(V, "QUERY_BLOCK", 9)
    x = np.random.default_rng(8).standard_normal((300, 6))
    q = x[::11]
    found = V.cosine_topk_batch(table(spark, x), table(spark, q, "query", "qvec"), 5)
    assert got(found) == brute(x, q, 5)


def test_odd_vectors(spark, tmp_path):
    rows = [np.array([1.0, 0]), None, np.array([0.0, 0]), np.array([-1e200, 1e200]), np.array([1e-200, 1e-200])]
    index = PivotIndex.build(table(spark, rows), str(tmp_path / "i"))
    queries = table(spark, [np.array([2.0, 0]), None, np.array([0.0, 0])], "query", "qvec")
    assert [(r.vec_id, round(r.similarity, 6)) for r in index.topk(queries, 10, into=str(tmp_path / "o")).orderBy("similarity").collect()] == [(3, -0.707107), (4, 0.707107), (0, 1.0)]
    empty = PivotIndex.build(table(spark, rows).where("false"), str(tmp_path / "e"))
    assert empty.topk(queries, 3, into=str(tmp_path / "p")).count() == 0
    assert index.topk(queries.where("false"), 3, into=str(tmp_path / "q")).count() == 0
