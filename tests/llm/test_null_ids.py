"""Near-duplicates among many rows without an id, and rows that share one: texts are found by id and content, not by id alone."""

import random

from barloom.llm import bagminhash


def test_many_rows_without_an_id(spark, make):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    pages = [[word() for _ in range(60)] for _ in range(500)]
    near = [p[:30] + ["changed"] + p[31:] for p in pages[:40]]
    rows = [(None if i % 2 else 7, " ".join(p)) for i, p in enumerate(pages)] + [(1000 + i, " ".join(p)) for i, p in enumerate(near)]
    found = bagminhash.classes(make(rows), content=True).collect()
    assert len(found) == len(rows)
    sizes = {r.content: r.class_size for r in found}
    paired = {r.content for r in found if r.doc_id is not None and r.doc_id >= 1000}
    assert all(sizes[c] == 2 for c in paired) and sum(v == 2 for v in sizes.values()) == 80
    joined = [n for n in str(bagminhash.representatives(make(rows))._jdf.queryExecution()).splitlines() if "CartesianProduct" in n or "NestedLoop" in n]
    assert not joined and bagminhash.representatives(make(rows)).count() >= 460
