"""The forest in few and in many dimensions: nodes split, dense groups stay whole, links are found."""

import numpy as np
import pytest

from barloom.llm import embeddings as E


def with_partners(n, dims, seed=1):
    """Random directions, and for each a second one at cosine 0.93 to 0.95."""
    rng = np.random.default_rng(seed)
    x = E.unit(rng.standard_normal((n, dims)))
    o = rng.standard_normal(x.shape)
    o = E.unit(o - (o * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9301, 0.95, n)[:, None]
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * o])


@pytest.mark.parametrize("dims", [64, 384, 768, 1024])
def test_nodes_split_in_any_dimension(dims):
    x = E.unit(np.random.default_rng(2).standard_normal((4096, dims)))
    nodes = E.grow(x, 4096 / 100_000, 5)
    assert len(nodes) == 2**E.DEPTH - 1
    rows, leaf = E.descend(nodes, x)
    assert len(np.unique(leaf)) == 2**E.DEPTH and len(rows) < 2.2 * len(x)


def test_dense_groups_are_leaves_and_are_not_cut_through():
    rng = np.random.default_rng(3)
    close = E.unit(np.ones(64) + 0.02 * rng.standard_normal((3000, 64)))
    assert E.grow(close, 1.0, 1) == []
    mixed = np.concatenate([E.unit(rng.standard_normal((3000, 64))), close[:600]])
    rows, leaf = E.descend(E.grow(mixed, 1.0, 1), mixed)
    member = np.zeros((600, leaf.max() + 1), int)
    member[rows[rows >= 3000] - 3000, leaf[rows >= 3000]] = 1
    assert len(np.unique(leaf)) > 20 and (member @ member.T > 0).all()  # whatever is cut, each two of the group meet
    assert len(rows) < 2.5 * len(mixed)
    assert E.grow(np.repeat(close[:1], 500, 0), 1.0, 1) == []


@pytest.mark.parametrize("dims", [64, 768])
def test_recall(spark, dims):
    x = with_partners(700, dims)
    df = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    cos = x @ x.T
    np.fill_diagonal(cos, 0)
    want = (cos >= E.THRESHOLD).sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() and want.sum() >= len(x)
